"""The registered queries of the ranking engine, each over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import bindings as D
from gleaner.functions import text as T
from gleaner.operators import evaluation as E
from gleaner.operators import ranking as R
from gleaner.operators.pool import JudgedPool
from gleaner.plans import base, judged
from gleaner.plans.oracle import ORACLE  # noqa: F401
from gleaner.sources.scratch import written

#: Products of either engine that are fused and reranked.
DEPTH = DEEP = 100
TABLES = base.TABLES
SYSTEMS = ("lexical", "semantic", "hybrid", "rerank")
#: A fixed linear model for the reranker's SQL-checked form: logits of grades 0, 1, 2 from three features.
LOGITS = ((0.3, -1.0, -0.5, -0.2), (0.1, 0.2, 0.4, 0.1), (-0.4, 1.5, 1.0, 0.6))
_PAIR = ["query_id", "product_id"]


class _Plans:
    """The intermediate tables that queries share, built when asked for; an index, the components of a fusion and the
    systems' rankings are written once and read by all that follows."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.made = spark, sf_dir, {}

    def once(self, name: str, make):
        if name not in self.made:
            self.made[name] = make()
        return self.made[name]

    def table(self, name: str) -> DataFrame:
        return D.table(self.spark, self.dir, name)

    def catalog(self) -> DataFrame:
        return D.vector_catalog(self.spark, self.dir)

    def queries(self) -> DataFrame:
        return D.vector_queries(self.spark, self.dir)

    def judged(self) -> E.ClassJudgments:
        return D.judged(self.spark, self.dir)

    def judgments(self) -> DataFrame:
        return D.judgments(self.spark, self.dir)

    def index(self) -> R.LexicalIndex:
        return self.once("index", lambda: R.LexicalIndex(self.catalog(), F.col("product_description")))

    def text_index(self) -> R.LexicalIndex:
        return self.once("text_index", lambda: R.LexicalIndex(D.catalog(self.spark, self.dir), F.col("product_description")))

    def whole_index(self) -> R.LexicalIndex:
        return self.once("whole_index", lambda: R.LexicalIndex(D.catalog(self.spark, self.dir), F.col("product_description"), max_features=None))

    def deep(self, k: int = 10) -> DataFrame:
        """Hybrid ranking of whole texts over all terms, DEEP products of either engine."""
        q, c = D.vector_queries(self.spark, self.dir, short=False), self.catalog()
        lexical = R.LexicalIndex(c, F.col("product_description"), max_features=None).search(q, DEEP, but_itself=True)
        return R.fuse(R.fused(lexical, R.semantic_search(q, c, DEEP)), R.weighted(0.9), k)

    def lexical(self, k: int = DEPTH) -> DataFrame:
        return self.index().search(self.queries(), k, but_itself=True)

    def semantic(self, k: int = DEPTH) -> DataFrame:
        return R.semantic_search(self.queries(), self.catalog(), k)

    def components(self) -> DataFrame:
        return self.once("components", lambda: written(R.fused(self.lexical(), self.semantic()), "components"))

    def hybrid(self, k: int = DEPTH) -> DataFrame:
        return R.fuse(self.components(), R.weighted(0.9), k)

    def features(self) -> DataFrame:
        return R.rerank_features(self.hybrid(), self.queries(), self.catalog(), DEPTH)

    def reranked(self, k: int = 10) -> DataFrame:
        return R.rerank(self.features(), fixed_model(), k)

    def rankings(self, k: int = 10) -> DataFrame:
        """(system, query_id, product_id, rank, score) of the four systems over the whole catalog."""

        def make() -> DataFrame:
            c, columns = self.components(), [*_PAIR, "rank", "score"]
            lexical = c.where(f"lexical_rank BETWEEN 1 AND {k}").select(*_PAIR, F.col("lexical_rank").alias("rank"), F.col("lexical_score").alias("score"))
            semantic = c.where(f"semantic_rank BETWEEN 1 AND {k}").select(*_PAIR, F.col("semantic_rank").alias("rank"), F.col("semantic_score").alias("score"))
            found = {"lexical": lexical, "semantic": semantic, "hybrid": self.hybrid(k), "rerank": self.reranked(k).withColumnRenamed("expected_relevance", "score")}
            return written(reduce(DataFrame.unionByName, [r.select(*columns, F.lit(s).alias("system")) for s, r in found.items()]), "rankings")

        return self.once("rankings", make)

    def judged_pool(self) -> JudgedPool:
        return self.once("judged_pool", lambda: JudgedPool(self.index(), self.queries(), self.catalog(), self.judged(), 0.9))

    def pool_best(self, k: int = 10) -> DataFrame:
        """Of the pool, the k best of either engine and the DEEP best of the fusion, without the pool's pairs."""
        return self.once(f"pool_best_{k}", lambda: written(self.judged_pool().best(k, DEEP), "pool-best"))

    def pool_plain(self) -> DataFrame:
        """Features of the DEEP best of the pool but for the engines' ranks, which count as absent."""
        return R.rerank_features(self.pool_best().where(F.col("rank") <= DEEP), self.queries(), self.catalog(), DEEP)

    def pool_features(self) -> DataFrame:
        """The same with the ranks, which are counted for these pairs only."""

        def make() -> DataFrame:
            best = self.pool_best().where(F.col("rank") <= DEEP)
            ranked = best.drop("lexical_rank", "semantic_rank").join(self.judged_pool().ranks(best), _PAIR)
            return written(R.rerank_features(ranked, self.queries(), self.catalog(), DEEP), "pool-features")

        return self.once("pool_features", make)

    def judged_lexical(self, k: int = 10) -> DataFrame:
        """The lexical ranking of judged_rankings() alone."""
        return self.once(f"judged_lexical_{k}", lambda: written(self.judged_pool().lexical_best(k), "judged-lexical").withColumn("system", F.lit("lexical")))

    def judged_rankings(self, k: int = 10) -> DataFrame:
        """(system, query_id, product_id, rank) of the four systems over each query's judged candidates."""

        def make() -> DataFrame:
            c = self.pool_best(k)
            deep = self.pool_plain()  # the fixed model looks at no rank
            found = {s: c.where(f"{s}_rank BETWEEN 1 AND {k}").select(*_PAIR, F.col(f"{s}_rank").alias("rank")) for s in ("lexical", "semantic")}
            found |= {"hybrid": c.where(F.col("rank") <= k), "rerank": R.rerank(deep, fixed_model(), k)}
            return written(reduce(DataFrame.unionByName, [r.select(*_PAIR, "rank", F.lit(s).alias("system")) for s, r in found.items()]), "judged-rankings")

        return self.once("judged_rankings", make)

    def records(self) -> DataFrame:
        return E.quality_records(self.queries(), self.judged_rankings(), self.judged(), SYSTEMS, "rerank")

    def pairs(self) -> DataFrame:
        """Each document with one benchmark item, as a query and a text to measure."""
        b = self.table("benchmark")
        n = b.agg((F.max("item_id") + 1).alias("n"))
        d = self.table("documents").crossJoin(F.broadcast(n)).withColumn("item_id", F.col("doc_id") % F.col("n"))
        return d.join(b.select("item_id", F.col("text").alias("query")), "item_id").select("doc_id", T.feature_tokens(F.col("query")).alias("q"), T.feature_tokens(F.col("text")).alias("t"))

    def requests(self) -> DataFrame:
        mode = F.element_at(F.array(*map(F.lit, ("lexical", "semantic", "hybrid", "fuzzy"))), (F.col("item_id") % 4 + 1).cast("int"))
        q = F.when(F.col("item_id") % 7 == 0, "\t \n").otherwise(F.col("text"))
        return self.table("benchmark").select(F.col("item_id").cast("string").alias("request_id"), q.alias("query"), (F.col("item_id") * 9).cast("int").alias("top_k"), mode.alias("mode"))

    def labelled(self) -> DataFrame:
        """Predictions of a document's language from its source, for the classification report."""
        return self.table("documents").select(F.col("lang").alias("label"), F.when(F.octet_length("text") > F.length("text"), "de").otherwise("en").alias("predicted"))


def fixed_model() -> Column:
    """Probabilities of the grades by the fixed model."""
    x = [F.col(c) for c in ("lexical_similarity", "semantic_similarity", "query_title_token_coverage")]
    return R.softmax([F.lit(b) + sum((F.lit(w) * c for w, c in zip(ws, x, strict=True)), F.lit(0.0)) for b, *ws in LOGITS])


QUERIES = {name: (lambda spark, sf_dir, f=f: f(_Plans(spark, sf_dir))) for name, f in (base.FOUND | judged.FOUND).items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search: ten products for each query, lexical and vector scores fused."""
    return base.scored(_Plans(spark, sf_dir).hybrid(10))
