"""A persistent vector index over Parquet: cells of near vectors, versions and tombstones.

Under one folder:

- ``cells``: one centroid for each cell, fitted by Spark's k-means on a sample of the first vectors. Every vector lies in the cell of the
  centroid that its direction is nearest to.
- ``vectors/batch=.../cell=...``: the rows, each write a batch of its own, one folder a cell.
- ``dead/batch=...``: documents whose rows in earlier versions are gone, because they were written anew or deleted.
- ``versions/n``: one row for each committed write: its version, its batch, and what it holds. A write counts from
  the moment that this row is there. Its folder must not exist: a writer that comes second takes the next version. Files of a write that failed
  are in no version and are never read.

A search compares each probe with the centroids, takes the rows of its nearest cells (all cells: the same as without an
index), drops dead ones and ranks by exact cosine. Probes travel to the rows, in blocks of a bounded size; rows stay
where they are read, and each task passes on its best rows of each probe only.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

CHUNK = T.StructType([
    T.StructField("tenant_id", T.StringType()), T.StructField("document_id", T.StringType()), T.StructField("chunk_index", T.IntegerType()),
    T.StructField("chunk_text", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("metadata", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
])
_STORED = T.StructType([*CHUNK, T.StructField("batch", T.StringType()), T.StructField("cell", T.IntegerType())])
_DEAD = T.StructType([*CHUNK[:2], T.StructField("batch", T.StringType())])
_VERSION = "version long, batch string, kind string, rows long, dead long"
_TIES = ("tenant_id", "document_id", "chunk_index", "chunk_text")
_CELL = "cell int, centroid array<double>"
#: Numbers that the probes of a block, or all centroids, may have to be sent to each task: 64 MB.
SENT = 8_000_000
#: Tombstones up to so many are broadcast; what versions say about their number decides, without a job.
BROADCAST_DEAD = 200_000
#: Rows that a task holds for all its probes before it drops those that are not among the best.
HELD = 100_000


def cosines(x: np.ndarray, probes: np.ndarray, digits: int) -> np.ndarray:
    """Rounded cosine of each row with each probe; 0 where either has no length."""
    sizes = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(probes, axis=1)
    return np.round(np.divide(x @ probes.T, sizes, out=np.zeros_like(sizes), where=sizes > 0), digits) + 0.0


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class VectorIndex:
    """Chunks with vectors of ``dim`` numbers in ``folder``; several processes may use one folder.

    ``folder`` must be one that the driver and all executors share. ``cells`` is how many the first write fits (None: the square root of
    its rows), on ``sample`` vectors at most; all rows are indexed.
    """

    def __init__(self, spark: SparkSession, folder: str, dim: int, cells: int | None = None, sample: int = 200_000, digits: int = 6) -> None:
        self.spark, self.folder, self.dim, self.cells, self.sample, self.digits = spark, folder.rstrip("/"), dim, cells, sample, digits

    # what is there

    def versions(self) -> list[Row]:
        """The committed writes since the last snapshot, oldest first."""
        found = self._table("versions/*", _VERSION)
        if found is None:  # nothing was written yet
            return []
        found = found.orderBy("version", "batch").collect()  # a row for each write
        start = max((i for i, v in enumerate(found) if v.kind == "snapshot"), default=0)
        return found[start:]

    def _table(self, name: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def rows(self) -> DataFrame:
        """All live chunks, with their cell."""
        return self._live(self.versions())

    def count(self) -> int:
        return self.rows().count()

    def health(self) -> dict[str, object]:
        known = self.versions()
        return {"healthy": True, "backend": "parquet", "details": {"version": known[-1].version if known else 0, "writes": len(known), "vectors": self._live(known).count(), "tombstones": sum(v.dead for v in known)}}

    def _live(self, known: list[Row], cells: list[int] | None = None) -> DataFrame:
        batches = [v.batch for v in known if v.rows]
        if not batches:
            return self.spark.createDataFrame([], _STORED).drop("batch")
        numbers = F.create_map(*[F.lit(x) for v in known for x in (v.batch, v.version)])
        rows = self.spark.read.schema(_STORED).parquet(f"{self.folder}/vectors").filter(F.col("batch").isin(batches))
        rows = rows if cells is None else rows.filter(F.col("cell").isin(cells))
        if not any(v.dead for v in known):
            return rows.drop("batch")
        gone = self.spark.read.schema(_DEAD).parquet(f"{self.folder}/dead").filter(F.col("batch").isin([v.batch for v in known if v.dead]))
        gone = gone.groupBy(F.col("tenant_id").alias("_t"), F.col("document_id").alias("_d")).agg(F.max(numbers[F.col("batch")]).alias("_gone"))
        gone = F.broadcast(gone) if sum(v.dead for v in known) <= BROADCAST_DEAD else gone
        older = F.col("tenant_id").eqNullSafe(F.col("_t")) & F.col("document_id").eqNullSafe(F.col("_d")) & (numbers[F.col("batch")] < F.col("_gone"))
        return rows.join(gone, older, "left_anti").drop("batch")

    # writes

    def upsert(self, chunks: DataFrame) -> int:
        """Puts the chunks' documents in place of what was there under their ids, and says how many chunks are indexed.

        Columns that ``chunks`` lacks are null, others are not kept. A chunk whose vector is null, of another length or
        has a null or a number that isn't finite can't be compared and is not indexed; its document is replaced all the same.
        Repeated chunks are kept as they are.
        """
        rows = self._chunks(chunks)
        usable = F.col("embedding").isNotNull() & (F.size("embedding") == self.dim) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        return self._write("rows", rows.filter(usable), rows.select("tenant_id", "document_id"))[0]

    def delete(self, documents: DataFrame) -> int:
        """Deletes all chunks of the documents (tenant_id, document_id), and says how many there were."""
        known = self.versions()
        asked = self._chunks(documents).select("tenant_id", "document_id")
        found = self._of(known, asked).count()
        self._write("rows", None, asked)
        return found

    def update_tags(self, documents: DataFrame) -> int:
        """New tags for the documents (tenant_id, document_id, tags), vectors as they are; says how many chunks have them now. Of a document named twice the least tags count."""
        asked = self._chunks(documents).groupBy("tenant_id", "document_id").agg(F.min("tags").alias("_tags"))
        known = self.versions()
        rows = self._of(known, asked).withColumn("tags", F.col("_tags")).select([f.name for f in CHUNK])
        return self._write("rows", rows, asked.select("tenant_id", "document_id"))[0]

    def clear(self) -> None:
        """No chunks from here on; the cells stay as they are."""
        self._commit("snapshot", uuid.uuid4().hex, 0, 0)

    def compact(self) -> int:
        """Writes all live chunks as one batch that takes the place of all earlier writes; says how many there are. Fails if another write came between."""
        known = self.versions()
        return self._write("snapshot", self._live(known).drop("cell"), None, after=known[-1].version if known else 0)[0]

    def _chunks(self, df: DataFrame) -> DataFrame:
        have = set(df.columns)
        return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in CHUNK])

    def _of(self, known: list[Row], documents: DataFrame) -> DataFrame:
        asked = documents.distinct().withColumnsRenamed({"tenant_id": "_t", "document_id": "_d"})
        return self._live(known).join(asked, F.col("tenant_id").eqNullSafe(F.col("_t")) & F.col("document_id").eqNullSafe(F.col("_d")))

    def _write(self, kind: str, rows: DataFrame | None, dead: DataFrame | None, after: int | None = None) -> tuple[int, int]:
        batch, sizes = uuid.uuid4().hex, [0, 0]
        if rows is not None:
            at = f"{self.folder}/vectors/batch={batch}"
            self._celled(rows).hint("rebalance", "cell").write.partitionBy("cell").option("compression", "zstd").parquet(at)
            sizes[0] = self._stored(at, _STORED)
        if dead is not None:
            at = f"{self.folder}/dead/batch={batch}"
            dead.distinct().write.parquet(at)
            sizes[1] = self._stored(at, _DEAD)
        self._commit(kind, batch, *sizes, after)
        return sizes[0], sizes[1]

    def _stored(self, at: str, schema: T.StructType) -> int:
        return self.spark.read.schema(T.StructType([f for f in schema if f.name != "batch"])).parquet(at).count()  # from the footers

    def _commit(self, kind: str, batch: str, rows: int, dead: int, after: int | None = None) -> None:
        while True:
            known = self.versions()
            last = known[-1].version if known else 0
            if after is not None and last != after:
                raise RuntimeError(f"version {last} came while the index was compacted from version {after}")
            try:
                self.spark.createDataFrame([(last + 1, batch, kind, rows, dead)], _VERSION).coalesce(1).write.mode("errorifexists").parquet(f"{self.folder}/versions/{last + 1}")
            except AnalysisException as e:
                if e.getCondition() != "PATH_ALREADY_EXISTS" or not any(v.version > last for v in self.versions()[-1:]):
                    raise
            else:
                return

    # cells

    def centroids(self) -> np.ndarray | None:
        """cells x dim, of length 1; None before the first write."""
        found = self._table("cells", _CELL)
        return None if found is None else _matrix(found.orderBy("cell").toArrow().column("centroid").combine_chunks())

    def _fitted(self, rows: DataFrame) -> np.ndarray:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        unit = rows.withColumn("_size", size).filter("_size > 0").select(F.transform("embedding", lambda x: x.cast("double") / F.col("_size")).alias("unit"))
        n = unit.count()
        k = min(self.cells or max(1, round(math.sqrt(n))), SENT // self.dim)
        some = unit.orderBy(F.xxhash64("unit")).limit(self.sample) if n > self.sample else unit
        if n < 2 or k < 2:
            found = [some.first().unit] if n else [[0.0] * self.dim]
        else:
            found = KMeans(k=k, seed=1, maxIter=10, featuresCol="v").fit(some.select(array_to_vector("unit").alias("v"))).clusterCenters()
        found = np.array([x / (np.linalg.norm(x) or 1) for x in np.asarray(found)])
        self.spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(found)], _CELL).coalesce(1).write.mode("ignore").parquet(f"{self.folder}/cells")
        return self.centroids()

    def _celled(self, rows: DataFrame) -> DataFrame:
        known = self.centroids()
        if known is None:
            known = self._fitted(rows)
        sent = self.spark.sparkContext.broadcast(known)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, cell = _matrix(batch.column("embedding")), np.empty(batch.num_rows, np.int32)
                step = max(1, 4_000_000 // len(sent.value))
                for at in range(0, len(x), step):
                    cell[at : at + step] = (x[at : at + step] @ sent.value.T).argmax(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

        return rows.mapInArrow(place, T.StructType([*rows.schema, T.StructField("cell", T.IntegerType())]))

    # search

    def search(self, probes: DataFrame, k: int, cells: int | None = None, least: float | None = None, allowed: Column | None = None) -> DataFrame:
        """query_id, rank, score and the chunk's columns: the ``k`` nearest of each (query_id, probe) by cosine, from ``least`` up.

        ``cells``: how many of each probe's nearest cells are read (None: all, which finds what a full comparison finds).
        ``allowed``: what a chunk must satisfy, before it is ranked. Equal scores go by tenant, document, chunk and text. A probe that is
        null or of another length finds nothing. Probes are sent out in blocks, each of which reads its cells once.
        """
        known, centroids = self.versions(), self.centroids()
        kinds = {f.name: f.dataType for f in probes.schema}
        out = T.StructType([T.StructField("query_id", kinds["query_id"]), T.StructField("score", T.DoubleType()), *CHUNK[:6]])
        empty = self.spark.createDataFrame([], out).withColumn("rank", F.lit(0))
        asked = probes.filter(F.size("probe") == self.dim).select("query_id", F.transform("probe", lambda x: x.cast("double")).alias("probe"))
        block = max(1, SENT // self.dim)
        number = asked.count()
        if centroids is None or not number:
            return empty.select("query_id", "rank", "score", *CHUNK.names[:6])
        found = None
        for i in range(blocks := -(-number // block)):  # one block for up to SENT numbers
            mine = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id", "probe"), F.lit(blocks)) == i)
            rows = mine.toArrow().combine_chunks()
            if rows.num_rows:
                told = self._scored(known, rows, centroids, k, cells, least, allowed, out)
                found = told if found is None else found.unionByName(told)
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), *[F.col(c).asc_nulls_last() for c in _TIES]))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "score", *CHUNK.names[:6])

    def _scored(self, known: list[Row], asked: pa.Table, centroids: np.ndarray, k: int, cells: int | None, least: float | None, allowed: Column | None, out: T.StructType) -> DataFrame:
        probes = _matrix(asked.column("probe").combine_chunks())
        ids = self.spark.createDataFrame(list(enumerate(asked.column("query_id").to_pylist())), T.StructType([T.StructField("_q", T.IntegerType()), out["query_id"]]))
        every = cells is None or cells >= len(centroids)
        of_cell: dict[int, np.ndarray] = {}
        if not every:
            near = np.argsort(-(probes @ centroids.T), axis=1, kind="stable")[:, :cells]
            order = np.argsort(near.ravel(), kind="stable")
            cut = np.unique(near.ravel()[order], return_index=True)
            of_cell = {int(c): np.sort(q) for c, q in zip(cut[0], np.split(order // cells, cut[1][1:]), strict=True)}
        rows = self._live(known, None if every else sorted(of_cell))
        rows = rows if allowed is None else rows.filter(allowed)
        sent, digits, names = self.spark.sparkContext.broadcast((probes, of_cell)), self.digits, CHUNK.names[:6]
        floor_at = -math.inf if least is None else least

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            probes, of_cell = sent.value
            floor = np.full(len(probes), floor_at)
            held: list[pa.Table] = []
            size = 0

            def cut() -> None:
                whole = pa.concat_tables(held).sort_by([("_q", "ascending"), ("score", "descending"), *[(c, "ascending") for c in _TIES]])
                q = whole.column("_q").to_numpy()
                turn = np.arange(len(q)) - np.searchsorted(q, q)
                full = turn == k - 1
                floor[q[full]] = np.maximum(floor[q[full]], whole.column("score").to_numpy()[full])
                held[:] = [whole.filter(pa.array(turn < k))]

            for batch in batches:
                x = _matrix(batch.column("embedding"))
                cell = batch.column("cell").to_numpy()
                table = pa.Table.from_batches([batch]).select(names)
                for c in np.unique(cell):
                    mine = np.flatnonzero(cell == c)
                    wanted = np.arange(len(probes)) if every else of_cell.get(int(c), np.zeros(0, int))
                    for at in range(0, len(wanted), step := max(1, 4_000_000 // max(1, len(mine)))):
                        some = wanted[at : at + step]
                        score = cosines(x[mine], probes[some], digits)
                        low = floor[some]
                        if len(mine) > k:
                            low = np.maximum(low, np.partition(score, len(mine) - k, axis=0)[len(mine) - k])
                        i, j = np.nonzero(score >= low)
                        if len(i):
                            held.append(table.take(pa.array(mine[i])).append_column("score", pa.array(score[i, j])).append_column("_q", pa.array(some[j].astype(np.int32))))
                            size += len(i)
                        if size > HELD:
                            cut()
                            size = held[0].num_rows
            if held:
                cut()
                yield from held[0].combine_chunks().to_batches()

        kept = T.StructType([*CHUNK[:6], T.StructField("score", T.DoubleType()), T.StructField("_q", T.IntegerType())])
        return rows.mapInArrow(best, kept).join(F.broadcast(ids), "_q").drop("_q")

