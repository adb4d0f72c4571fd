"""Files of a latent semantic analysis and the steps between them, each a folder of text lines named by its kind.

``WCS`` and ``FVS`` hold a line ``i v i v ...`` for each document in the order of its id, ``WD2ID``, ``DOC2ID`` lines
``name<tab>id``, ``EXC`` names to be left out, ``SCA`` lines ``i j cosine``, ``U``, ``S``, ``V`` the decomposition,
``SET`` lines ``set<tab>name`` and ``SIM`` lines ``name<tab>name``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.operators import lsa
from folium.operators.index import first_seen, with_ids
from folium.sources.files import read_matrix, sparse_matrix


class LsaFolder:
    """The files below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _put(self, kind: str, rows: DataFrame, line: Column, *order: str) -> None:
        ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
        ranged.select(line.alias("value")).write.mode("overwrite").text(f"{self.path}/{kind}")

    def _names(self, kind: str) -> DataFrame:
        parts = F.split("value", "\t")
        return self.spark.read.text(f"{self.path}/{kind}").select(parts[0].alias("name"), parts[1].cast("long").alias("id"))

    def _put_rows(self, kind: str, rows: DataFrame, docs: DataFrame) -> None:
        """``id, word, v`` as a line for each document, empty ones too."""
        pairs = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("word", "v"))).alias("x"))
        joined = docs.select("id").join(pairs, "id", "left")
        text = F.array_join(F.transform(F.coalesce("x", F.array().cast("array<struct<word:bigint,v:double>>")), lambda x: F.concat_ws(" ", x["word"].cast("string"), F.format_string("%s", x["v"]))), " ")
        self._put(kind, joined, text, "id")

    def _rows(self, kind: str) -> DataFrame:
        return sparse_matrix(read_matrix(self.spark, f"{self.path}/{kind}")).select(F.col("row").alias("id"), F.col("col").alias("word"), F.col("value").alias("v"))

    def count(self, docs: DataFrame, stop_words: DataFrame | None = None) -> None:
        """``docs(name, text)`` to word counts and the ids of words and documents."""
        ids = with_ids(docs.select("name").distinct(), ["name"])
        self._put("DOC2ID", ids, F.concat_ws("\t", "name", F.col("id").cast("string")), "id")
        counts = lsa.token_counts(docs.join(self._names("DOC2ID"), "name").select("id", "text"), stop_words, key="id")
        words = first_seen(counts.select(F.col("term").alias("word"), F.col("id").alias("first")))
        self._put("WD2ID", words, F.concat_ws("\t", "word", F.col("id").cast("string")), "id")
        known = self._names("WD2ID").select(F.col("name").alias("term"), F.col("id").alias("word"))
        self._put_rows("WCS", counts.join(known, "term").select("id", "word", F.col("tf").cast("double").alias("v")), self._names("DOC2ID"))

    def weigh(self, local: str = "log", globally: str = "entropy") -> None:
        """Word counts to feature values."""
        counts = self._rows("WCS").select("id", F.col("word").alias("term"), F.col("v").cast("long").alias("tf"))
        self._put_rows("FVS", lsa.features(counts, local, globally, key="id").select("id", F.col("term").alias("word"), F.col("w").alias("v")), self._names("DOC2ID"))

    def decompose(self, rank: int = 10, threshold: float = 0.0, exclude: bool = False, u: bool = False, s: bool = False, v: bool = False) -> None:
        """Feature values to the cosines of documents in the space of the leading components, and the matrices asked for."""
        if rank <= 0:
            raise ValueError("the rank has to be positive")
        rows = self._rows("FVS")
        if exclude:
            names = self.spark.read.text(f"{self.path}/EXC").select(F.explode(F.split("value", "\\s+")).alias("name"))
            rows = lsa.without_excluded(rows, self._names("DOC2ID").join(names, "name", "left_semi"), "id", "v")
        scores, right = lsa.pca(rows.select(F.col("id").alias("row"), F.col("word").alias("col"), F.col("v").alias("value")), rank)
        placed = scores.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("component", "value"))), lambda x: x["value"]).alias("embedding"))
        pairs = lsa.block_pairs(placed.select(F.col("row").alias("vec_id"), "embedding"), threshold)
        self._put("SCA", pairs, F.concat_ws(" ", F.col("i").cast("string"), F.col("j").cast("string"), F.format_string("%.6f", "cos")), "i", "j")
        norms = [r[0] for r in scores.groupBy("component").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("s")).orderBy("component").select("s").collect()]
        shown = lambda a: F.array_join(F.transform(a, lambda x: F.format_string("%+f", x)), " ")
        if u:
            self._put("U", placed.select("row", F.zip_with("embedding", F.array(*map(F.lit, norms)), lambda x, n: x / n).alias("e")), shown("e"), "row")
        if s:
            self._put("S", self.spark.createDataFrame([(k, float(x)) for k, x in enumerate(norms)], "k int, s double"), F.format_string("%+f", "s"), "k")
        if v:
            self._put("V", self.spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(right)], "row int, e array<double>"), shown("e"), "row")

    def _similar(self, threshold: float) -> DataFrame:
        parts = F.split("value", " ")
        rows = self.spark.read.text(f"{self.path}/SCA").select(parts[0].cast("long").alias("i"), parts[1].cast("long").alias("j"), parts[2].cast("double").alias("cos"))
        return rows.where(F.col("cos") >= threshold)

    def sets(self, threshold: float = 0.0) -> None:
        """Documents linked by cosines of the threshold or more, set by set."""
        found = lsa.components(self._similar(threshold)).join(self._names("DOC2ID").withColumnRenamed("id", "node"), "node")
        self._put("SET", found, F.concat_ws("\t", F.col("component").cast("string"), "name"), "component", "name")

    def similar(self, threshold: float = 0.0) -> None:
        """Names of the pairs of the threshold or more."""
        named = lsa.named(self._similar(threshold), self._names("DOC2ID"), ["i", "j"])
        self._put("SIM", named, F.concat_ws("\t", "i_name", "j_name"), "i", "j")

    def read_pairs(self) -> DataFrame:
        return self._similar(float("-inf"))
