"""Processing only new or changed records, run by run.

Deliveries carry their place in the commit sequence: numbers that only rise. A run reads the deliveries in
(watermark, upper]: the watermark is the upper limit of the last committed run, the upper limit is fixed
before the run reads anything and never lies below the watermark. Output, state and watermark become visible together by the
rename of one commit record, so a run that fails leaves nothing behind and the next one takes its records again.

``IncrementalStore`` executes runs, ``DeliveryLog`` numbers what is delivered, and ``taken_by_runs`` replays the runs of a
history through a store: the i-th succeeded runs of all roots are the i-th commit.

Defined results: observations without hash, path, root or time are no
observations; repeated rows are one; late rows count for the first run that
completes after their delivery; a file not seen keeps its state; the manifest is known before every run of its root.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.sources.tables import _hadoop, shared_dir

def hash_value(c: Column) -> Column:
    """A hash by its value: without white space, algorithm prefix and letter case."""
    t = F.lower(F.regexp_replace(c, r"(?U)\s+", ""))
    t = F.regexp_replace(t, r"^(?:[a-z0-9_-]+:|0x)", "")
    return F.when(t != "", t)


def observations(manifest: DataFrame, scan: DataFrame) -> DataFrame:
    """(root, path, hash, observed, tie, delivered) of both sources; manifest rows have no tie and no delivery."""
    m = manifest.select(
        F.col("canonical_root").alias("root"), F.col("canonical_path").alias("path"), hash_value(F.col("content_hash")).alias("hash"),
        F.col("last_synced").alias("observed"), F.lit(None).cast("long").alias("tie"), F.lit(None).cast("timestamp").alias("delivered"),
    )
    s = scan.filter(F.col("delivered_at").isNotNull()).select(
        F.col("canonical_root").alias("root"), F.col("canonical_path").alias("path"), hash_value(F.col("content_hash")).alias("hash"),
        F.col("observed_at").alias("observed"), F.col("scan_row_id").alias("tie"), F.col("delivered_at").alias("delivered"),
    )
    return m.unionByName(s).dropna(subset=["root", "path", "hash", "observed"])


def run_windows(runs: DataFrame) -> DataFrame:
    """(root, uppers): per root the succeeded runs in commit order. One small array per root."""
    ok = runs.filter((F.lower(F.trim("status")) == "succeeded") & F.col("finished_at").isNotNull())
    return ok.groupBy(F.col("canonical_root").alias("root")).agg(
        F.array_sort(F.collect_set(F.struct(F.col("finished_at").alias("upper"), "run_id"))).alias("uppers")
    )


def taken_by_runs(obs: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, path) of every file whose state is new or different at a succeeded run."""
    spark = obs.sparkSession
    windows = run_windows(runs)
    # place 0 is what was known before every run, place i what the i-th succeeded run of the root is the first to see
    placed = obs.join(windows, "root").select(
        "root", "path", "hash", "observed", "tie",
        F.when(F.col("delivered").isNull(), F.lit(0))
        .otherwise(F.size(F.filter("uppers", lambda u: u["upper"] < F.col("delivered"))) + 1).alias("seq"),
        F.size("uppers").alias("last"),
    ).filter(F.col("seq") <= F.col("last")).drop("last")
    path = f"{shared_dir(spark)}/corvane-{spark.sparkContext.applicationId}/runs-{uuid.uuid4().hex}"
    log = DeliveryLog(spark, f"{path}/log")
    # of the observations that one run is the first to see only the latest matters
    log.load(placed.groupBy("root", "path", "seq").agg(F.max(F.struct("observed", "tie", "hash")).alias("o")).select("root", "path", "o.*", "seq"))
    fs, p = _hadoop(spark, path)
    fs.deleteOnExit(p)
    store = IncrementalStore(spark, f"{path}/store", ("root", "path"))
    most = windows.agg(F.max(F.size("uppers"))).first()[0] or 0
    if not log.filled():  # no run, or nothing that a run could see
        return runs.select("run_id", F.lit(None).cast("string").alias("path")).limit(0)
    store.begin(log)
    for upper in range(1, most + 1):
        store.run(log, upper)
    # the commit's number is the place of the run among its root's runs
    return store.output().join(windows, "root").select(F.element_at("uppers", F.col("sequence")).getField("run_id").alias("run_id"), "path")


def files_taken(manifest: DataFrame, scan: DataFrame, runs: DataFrame) -> DataFrame:
    """Files that each succeeded run has to take."""
    return taken_by_runs(observations(manifest, scan), runs).select("run_id", F.col("path").alias("canonical_path"))


class Stale(RuntimeError):
    """A run's upper limit lies below the watermark, or another run committed first."""


def _rename(spark, a: str, b: str) -> None:
    """Moves a file or folder; fails if the target exists."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs
    none = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    source, target = fs.Path(a), fs.Path(b)
    context = fs.FileContext.getFileContext(source.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(source, target, none)
    except Exception as e:  # the JVM's own errors come wrapped
        raise Stale(f"{b} exists or can't be made") from e


def _names(spark, path: str) -> list[str]:
    fs, p = _hadoop(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


class DeliveryLog:
    """Delivered rows in numbered parts: ``seq=N`` is the N-th delivery, whatever times its rows carry."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path
        fs, p = _hadoop(spark, path)
        fs.mkdirs(p)

    def last(self) -> int:
        """Number of the last delivery, 0 if none."""
        return max([0, *(int(n[4:]) for n in _names(self.spark, self.path) if n.startswith("seq="))])

    def filled(self) -> bool:
        """Whether anything was delivered."""
        return any(n.startswith("seq=") for n in _names(self.spark, self.path))

    def append(self, rows: DataFrame) -> int:
        """Lands rows as the next delivery and returns its number. Of two that race for a number one fails and may try again."""
        n = self.last() + 1
        stage = f"{self.path}/_stage-{uuid.uuid4().hex}"
        rows.write.parquet(stage)
        _rename(self.spark, stage, f"{self.path}/seq={n}")
        return n

    def load(self, rows: DataFrame) -> None:
        """Fills an empty log with rows that carry their number ``seq``, as at the replay of a history."""
        rows.write.partitionBy("seq").mode("append").parquet(self.path)

    def between(self, low: int, upper: int) -> DataFrame | None:
        """Rows of the deliveries in (low, upper]; only their parts are read."""
        parts = [f"{self.path}/{n}" for n in _names(self.spark, self.path) if n.startswith("seq=") and low < int(n[4:]) <= upper]
        return self.spark.read.parquet(*sorted(parts)) if parts else None


class IncrementalStore:
    """Committed runs in a folder of the shared file system.

    ``data/ID`` holds the rows whose state a run changed, with the mark ``taken`` for the run's output; ``commits/N.json``
    makes run N visible: its window, its folder, and the folders that make up the state after it. The state of a key is
    the latest of its rows, so a run writes only what it changed; every ``compact`` runs the folders are written
    together as one. Two runs that race for the same N can't both win, since the rename of a record onto an existing one fails.
    """

    def __init__(self, spark, path: str, keys: tuple[str, ...] = ("path",), compact: int = 16):
        self.spark, self.path, self.keys, self.compact = spark, path, list(keys), compact
        for part in ("commits", "data"):
            fs, p = _hadoop(spark, f"{path}/{part}")
            fs.mkdirs(p)

    def sequence(self) -> int:
        """Number of the last committed run, -1 if none; 0 is what was known before every run."""
        return max([-1, *(int(n[:-5]) for n in _names(self.spark, f"{self.path}/commits") if n.endswith(".json") and n[0] != "_")])

    def commit(self, n: int) -> dict:
        """The record of a committed run."""
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/commits/{n}.json", wholetext=True).collect()))

    def watermark(self) -> int:
        """Upper limit of the last committed run; what is delivered later is yet to be taken."""
        n = self.sequence()
        return self.commit(n)["upper"] if n >= 0 else -1

    def state(self) -> DataFrame | None:
        """(keys, observed, tie, hash) as of the watermark."""
        n = self.sequence()
        return self._latest(self._rows(self.commit(n)["state"])).select(*self.keys, "o.*") if n >= 0 else None

    def output(self) -> DataFrame:
        """(sequence, keys, hash) that all committed runs took."""
        found = None
        for n in range(1, self.sequence() + 1):
            own = self._rows([self.commit(n)["data"]]).filter("taken").select(F.lit(n).alias("sequence"), *self.keys, "hash")
            found = own if found is None else found.unionByName(own)
        if found is None:
            found = self.spark.createDataFrame([], "sequence int, " + ", ".join(f"{k} string" for k in self.keys) + ", hash string")
        return found

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/data/{f}" for f in folders])

    def _latest(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(F.max(F.struct("observed", "tie", "hash")).alias("o"))

    def begin(self, log: DeliveryLog) -> None:
        """Commit 0: what is known before every run, which nobody takes."""
        if self.sequence() < 0:
            known = log.between(-1, 0)
            rows = (log.between(-1, 1 << 62) if known is None else known)
            if rows is None:
                raise ValueError("the log is empty")
            rows = self._latest(rows if known is not None else rows.limit(0)).select(*self.keys, "o.*", F.lit(False).alias("taken"))
            self._publish(0, -1, 0, rows, [], None)

    def _publish(self, n: int, low: int, upper: int, rows: DataFrame, state: list[str], before_commit) -> str:
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{folder}")
        held = [*state, folder]
        if len(held) > self.compact:
            whole = uuid.uuid4().hex
            self._latest(self._rows(held)).select(*self.keys, "o.*", F.lit(False).alias("taken")).write.parquet(f"{self.path}/data/{whole}")
            held = [whole]
        if before_commit:
            before_commit()
        stage = f"{self.path}/commits/_{folder}"
        fs, p = _hadoop(self.spark, stage)
        out = fs.create(p, False)
        out.write(bytearray(json.dumps({"sequence": n, "lower": low, "upper": upper, "data": folder, "state": held}).encode()))
        out.close()
        _rename(self.spark, stage, f"{self.path}/commits/{n}.json")
        return folder

    def run(self, log: DeliveryLog, upper: int | None = None, before_commit=None) -> DataFrame:
        """Take what the deliveries in (watermark, upper] made new or different, commit it with the new watermark, and return it.

        The log's rows have the keys, hash, observed and tie. ``upper`` is the log's last delivery if none is given; it is fixed
        before anything is read. One below the watermark is refused; one at the watermark has nothing to take and commits nothing.
        Nothing is visible until the record's rename; an exception before it, such as one thrown by ``before_commit``, leaves
        the store as it was.
        """
        if self.sequence() < 0:
            self.begin(log)
        n = self.sequence()
        last = self.commit(n)
        low = last["upper"]
        upper = log.last() if upper is None else upper
        if upper < low:
            raise Stale(f"upper limit {upper} lies below the watermark {low}")
        known = self._rows(last["state"])
        fresh = log.between(low, upper)
        if upper == low:
            return known.select(*self.keys, "hash").limit(0)
        new = self._latest(fresh if fresh is not None else known.limit(0)).withColumnRenamed("o", "n")
        both = new.join(self._latest(known), self.keys, "left").filter(F.col("o").isNull() | (F.col("n") > F.col("o")))
        rows = both.select(*self.keys, "n.*", (F.col("o").isNull() | (F.col("o.hash") != F.col("n.hash"))).alias("taken"))
        folder = self._publish(n + 1, low, upper, rows, last["state"], before_commit)
        return self._rows([folder]).filter("taken").select(*self.keys, "hash")
