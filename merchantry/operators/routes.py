"""Routes: fit on train DataFrames, predict whole DataFrames.

A route's prediction frame is (txn_id, canonical_merchant, category, direction, ...).
Costly steps (fuzzy match, model calls, vector search) run once per *distinct*
query text and are joined back, which is where repeated descriptors pay off.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantry import constants as K
from merchantry.functions.labels import cascade_select, guard_category, guard_merchant
from merchantry.functions.synth import direction
from merchantry.functions.text import clean_description, derive_canonical, strip_processor_prefix
from merchantry.operators.aggregates import global_majority, known_list, majority_category
from merchantry.operators.fuzzy import JOIN_CUTOFF, NameIndex, fuzzy_top1, fuzzy_topk
from merchantry.session import materialize

PRED_COLS = ["txn_id", "canonical_merchant", "category", "direction"]


class Route:
    """Subclass and implement ``fit`` and ``transform`` over DataFrames."""
    name = "base"

    def fit(self, train_feed: DataFrame, train_gold: DataFrame) -> "Route":
        return self

    def transform(self, feed: DataFrame) -> DataFrame:  # pragma: no cover - interface
        raise NotImplementedError


def with_gold_defaults(gold: DataFrame) -> DataFrame:
    """Gold frames without a txn_type column get a null one."""
    return gold if "txn_type" in gold.columns else gold.withColumn("txn_type", F.lit(None).cast("string"))


def query_text(desc) -> Column:
    """The cleaned text routes match on: B2(B3(B1(description)))."""
    return clean_description(derive_canonical(strip_processor_prefix(desc)))


class CleanerRoute(Route):
    """merchant = B3(B1(description)); no category."""
    name = "cleaner"

    def transform(self, feed: DataFrame) -> DataFrame:
        return feed.select("txn_id",
                           derive_canonical(strip_processor_prefix("description")).alias("canonical_merchant"),
                           F.lit(None).cast("string").alias("category"),
                           direction("amount").alias("direction"))


class RulesRoute(Route):
    """Fuzzy top-1 (>= cutoff) against the learned list; category from the learned
    mcc prior, else the label prior of the predicted merchant, else the majority."""
    name = "rules"

    def __init__(self, cutoff: float = K.FUZZY_CUTOFF, scorer: str = "token_set"):
        self.cutoff, self.scorer = cutoff, scorer

    def fit(self, train_feed: DataFrame, train_gold: DataFrame) -> "RulesRoute":
        train_gold = with_gold_defaults(train_gold)
        j = train_feed.select("txn_id", "mcc").join(
            train_gold.select("txn_id", "category", "canonical_merchant", "txn_type"), "txn_id")
        # small tables that every transform reads are written once
        self.names = materialize(known_list(j), "known_list")
        self.index = NameIndex(self.names, self.cutoff) if self.scorer == "token_set" and self.cutoff >= JOIN_CUTOFF else None
        lab = j.withColumn("label", F.coalesce("canonical_merchant", "txn_type"))
        self.label_prior = materialize(majority_category(lab, "label").withColumnRenamed("category", "_label_cat"), "label_prior")
        self.mcc_prior = materialize(majority_category(j, "mcc").withColumnRenamed("category", "_mcc_cat"), "mcc_prior")
        row = global_majority(train_gold).first()
        self.default = row[0] if row else K.DEFAULT_CATEGORY
        return self

    @staticmethod
    def texts(feed: DataFrame) -> DataFrame:
        """The distinct texts of a feed: what is matched, and its fallback, which the rows are joined on."""
        fallback = derive_canonical(strip_processor_prefix("description"))
        return feed.select(fallback.alias("_fallback")).withColumn("query", clean_description("_fallback")).distinct()

    def match_texts(self, texts: DataFrame) -> DataFrame:
        """``texts`` (query, _fallback) with match and label prior, for ``transform``."""
        best = fuzzy_top1(texts.select("query"), self.index or self.names, self.cutoff, scorer=self.scorer)
        texts = self._labelled(texts.join(best.select("query", F.col("name").alias("_match")), "query", "left"))
        return texts.select("_fallback", "_match", "canonical_merchant", "_label_cat")

    def transform(self, feed: DataFrame, matched: DataFrame | None = None) -> DataFrame:
        """Predictions of ``feed``; ``matched``, if given, is what ``match_texts`` gave for all of its texts or more."""
        d = feed.select("txn_id", "description", "mcc", "amount").withColumn(
            "_fallback", derive_canonical(strip_processor_prefix("description")))
        if d.isStreaming:
            # Per-row scoring; a stream cannot be de-duplicated and joined back
            from merchantry.operators.fuzzy import fuzzy_top1_rows
            d = d.withColumn("query", clean_description("_fallback"))
            d = fuzzy_top1_rows(d, "query", self.names, self.cutoff).drop("_match_score")
            d = self._labelled(d)
        else:
            # match and label prior once per text; the rows are joined once, on the text
            d = d.join(self.match_texts(self.texts(feed)) if matched is None else matched, "_fallback", "left")
        d = d.join(self.mcc_prior, "mcc", "left")
        cat = F.coalesce("_mcc_cat", "_label_cat", F.lit(self.default))
        return d.select("txn_id", "canonical_merchant", cat.alias("category"),
                        direction("amount").alias("direction"), F.col("_match").isNull().alias("no_match"))

    def _labelled(self, d: DataFrame) -> DataFrame:
        d = d.withColumn("canonical_merchant", F.coalesce("_match", "_fallback"))
        return d.join(self.label_prior.withColumnRenamed("label", "canonical_merchant"), "canonical_merchant", "left")


def candidates(feed: DataFrame, names: DataFrame, k: int = K.TOP_K, scorer: str = "token_set") -> DataFrame:
    """C6 for a feed: (txn_id, candidates) from the distinct queries' top-k."""
    d = feed.select("txn_id", query_text("description").alias("query"))
    top = fuzzy_topk(d.select("query"), names, k, scorer=scorer)
    return d.join(top.select("query", "candidates"), "query", "left").select("txn_id", "candidates")


# ------------------------------------------------------------------ model-function routes
def call_model(df: DataFrame, key_col: str, fn: Callable[[list[str]], list[str]],
               payload_col: str | None = None, out_col: str = "reply") -> DataFrame:
    """Run a user model function once per DISTINCT ``key_col`` value inside
    executors (batches of payload strings in, reply strings out); returns
    (key, reply). ``payload_col`` (the prompt or request, a function of the key)
    defaults to the key itself; the de-duplication and the join back use the short
    key, not the long payload."""
    import pandas as pd
    payload_col = payload_col or key_col
    cols = [key_col] if payload_col == key_col else [key_col, payload_col]
    distinct = df.select(*cols).dropDuplicates([key_col])

    def run(it):
        for pdf in it:
            yield pd.DataFrame({key_col: pdf[key_col].tolist(), out_col: list(fn(pdf[payload_col].tolist()))})
    return distinct.mapInPandas(run, f"{key_col} string, {out_col} string")


def allowed_categories(train_gold: DataFrame, given=None) -> list[str]:
    """The given categories, else the sorted labels of the train rows (a label set)."""
    if given is not None:
        return list(given)
    rows = train_gold.select("category").filter("category is not null").distinct().orderBy("category").collect()
    return [r[0] for r in rows] or list(K.CATEGORIES)


class GeneratorRoute(Route):
    """Prompt (B23) -> model function -> JSON reply (B24) -> guards."""
    name = "generator"

    def __init__(self, chat_fn, prompt_fn=None, strip_prefix: bool = True, name: str | None = None,
                 categories=None):
        self.chat_fn, self.prompt_fn = chat_fn, prompt_fn
        self.strip_prefix, self._given = strip_prefix, categories
        if name:
            self.name = name

    def fit(self, train_feed, train_gold):
        self.categories = allowed_categories(train_gold, self._given)
        row = global_majority(train_gold).first()
        self.default = row[0] if row else K.DEFAULT_CATEGORY
        return self

    def transform(self, feed: DataFrame) -> DataFrame:
        from merchantry.functions.prompts import build_prompt, parse_response
        text = strip_processor_prefix("description") if self.strip_prefix else F.col("description")
        d = feed.select("txn_id", "amount", text.alias("_text"))
        d = d.withColumn("prompt", (self.prompt_fn or build_prompt)(F.col("_text"), self.categories))
        replies = materialize(call_model(d, "_text", self.chat_fn, payload_col="prompt"), "replies")
        parsed = replies.withColumn("_p", parse_response("reply"))
        d = d.join(parsed.select("_text", "_p"), "_text", "left")
        return d.select(
            "txn_id",
            guard_merchant(F.col("_p.merchant"), derive_canonical("_text")).alias("canonical_merchant"),
            guard_category(F.col("_p.category"), self.categories, self.default).alias("category"),
            direction("amount").alias("direction"))


class ChoiceRoute(Route):
    """Choice model picks a category and (optionally) one of the top-k merchant
    candidates; anything that was not offered is ``none`` and keeps the cleaned text. Without
    candidates the merchant is the rules matcher's. R7 sends ``none`` rows to a generator."""
    name = "choice"

    def __init__(self, call_fn, with_candidates: bool = True, fallback: GeneratorRoute | None = None,
                 categories=None, k: int = K.TOP_K):
        self.call_fn, self.with_candidates, self.fallback = call_fn, with_candidates, fallback
        self._given, self.k = categories, k

    def fit(self, train_feed, train_gold):
        train_gold = with_gold_defaults(train_gold)
        j = train_feed.select("txn_id").join(
            train_gold.select("txn_id", "canonical_merchant", "txn_type"), "txn_id")
        self.names = known_list(j).filter(F.col("kind") == "merchant")
        self.categories = allowed_categories(train_gold, self._given)
        if not self.with_candidates:
            self.rules = RulesRoute().fit(train_feed, train_gold)
        row = global_majority(train_gold).first()
        self.default = row[0] if row else K.DEFAULT_CATEGORY
        if self.fallback is not None:
            self.fallback.fit(train_feed, train_gold)
        return self

    def transform(self, feed: DataFrame) -> DataFrame:
        from merchantry.functions.prompts import choice_request, parse_choice
        d = feed.select("txn_id", "description", "amount").withColumn(
            "_state", strip_processor_prefix("description"))
        if self.with_candidates:
            # written: the requests, the answers and the escalated rows read them
            d = d.join(materialize(candidates(feed, self.names, self.k), "candidates"), "txn_id", "left")
        else:
            matched = self.rules.transform(feed).select("txn_id", F.col("canonical_merchant").alias("_ruled"))
            d = d.withColumn("candidates", F.array().cast("array<string>")).join(matched, "txn_id", "left")
        d = d.withColumn("request", F.to_json(choice_request(F.col("_state"), self.categories,
                                                             F.col("candidates"))))
        # one call per request: the request depends on the stripped text alone, and its reply is
        # written, so that the branches below do not ask again
        replies = materialize(call_model(d, "_state", self.call_fn, payload_col="request"), "replies")
        d = d.join(replies, "_state", "left")
        c = parse_choice(F.col("reply"))
        d = (d.withColumn("_c", c)
             .withColumn("none", ~F.coalesce(F.array_contains("candidates", F.col("_c.merchant.choice")), F.lit(False))
                         if self.with_candidates else F.lit(False)))
        picked = F.col("_c.merchant.choice") if self.with_candidates else F.col("_ruled")
        out = d.select(
            "txn_id", "description", "amount", "candidates",
            guard_merchant(F.when(~F.col("none"), picked), derive_canonical("_state")).alias("canonical_merchant"),
            guard_category(F.col("_c.category.choice"), self.categories, self.default).alias("category"),
            F.col("_c.merchant.confidence").alias("choice_confidence"),
            F.col("_c.merchant.p_choice").alias("choice_p_choice"),
            F.col("_c.merchant.p_none").alias("choice_p_none"),
            F.col("_c.category.confidence").alias("choice_category_confidence"),
            F.col("_c.input_tokens").alias("choice_input_tokens"),
            "none",
            direction("amount").alias("direction"))
        if self.fallback is None:
            return out.drop("description", "amount")
        # Only the none rows reach the generator; their category stays.
        nones = out.filter("none")
        gen = self.fallback.transform(nones.select("txn_id", "description", "amount"))
        fixed = nones.drop("canonical_merchant").join(
            gen.select("txn_id", "canonical_merchant"), "txn_id", "left")
        return (out.filter(~F.col("none")).unionByName(fixed.select(out.columns))
                .drop("description", "amount").withColumn("escalated", F.col("none")))


def cascade(first: DataFrame, second: DataFrame, gate: Column, cols=("canonical_merchant",)) -> DataFrame:
    """R8/R13 (B32): per row take ``first``'s columns where ``gate`` holds, else
    ``second``'s. Both frames are keyed by txn_id; ``gate`` may use ``f_``/``s_``
    prefixed columns."""
    f = first.select("txn_id", *[F.col(c).alias(f"f_{c}") for c in first.columns if c != "txn_id"])
    s = second.select("txn_id", *[F.col(c).alias(f"s_{c}") for c in second.columns if c != "txn_id"])
    j = f.join(s, "txn_id")
    return j.select("txn_id", *[cascade_select(gate, F.col(f"f_{c}"), F.col(f"s_{c}")).alias(c)
                                for c in cols], gate.alias("kept_first"))


def run_route(route: Route, train_feed: DataFrame, train_gold: DataFrame, feed: DataFrame) -> DataFrame:
    """Fit then predict a whole frame."""
    return route.fit(train_feed, train_gold).transform(feed)


# ------------------------------------------------------------------ Spark ML routes
def _logreg(n_rows: int, features: str = "features", label: str = "label_idx", weight: str | None = None):
    """Multinomial logistic regression with the penalty of the usual C=1 default:
    regParam = 1/n, L2, no standardisation. ``weight`` is a column with the number of rows that a row stands for."""
    from pyspark.ml.classification import LogisticRegression
    model = LogisticRegression(featuresCol=features, labelCol=label, maxIter=1000,
                               regParam=1.0 / max(n_rows, 1), elasticNetParam=0.0,
                               standardization=False, family="multinomial")
    return model.setWeightCol(weight) if weight else model


class MetadataRoute(Route):
    """R2 (B33): category from metadata only — one-hot(type code), one-hot(mcc or
    'none') with unseen values ignored, log1p(|amount|) — through a Spark ML pipeline.
    Merchant is always null."""
    name = "metadata"

    def fit(self, train_feed, train_gold):
        from pyspark.ml import Pipeline, PipelineModel
        from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
        # the rows are joined once; equal ones are one weighted row of the regression, which passes over them
        # some hundred times
        j = self._prep(train_feed).join(train_gold.select("txn_id", "category"), "txn_id")
        j = materialize(j.select("transaction_type_code", "mcc_s", "log_amt", "category"), "metadata_rows")
        prepare = Pipeline(stages=[
            StringIndexer(inputCols=["transaction_type_code", "mcc_s"], outputCols=["tc_i", "mcc_i"],
                          handleInvalid="keep"),
            OneHotEncoder(inputCols=["tc_i", "mcc_i"], outputCols=["tc_v", "mcc_v"],
                          handleInvalid="keep", dropLast=True),
            VectorAssembler(inputCols=["tc_v", "mcc_v", "log_amt"], outputCol="features"),
            StringIndexer(inputCol="category", outputCol="label_idx"),
        ]).fit(j)
        rows = materialize(j.groupBy(*j.columns).agg(F.count(F.lit(1)).cast("double").alias("weight")), "metadata_weights")
        model = _logreg(j.count(), weight="weight").fit(prepare.transform(rows))
        self.model = PipelineModel(stages=[*prepare.stages, model])
        self.labels = self.model.stages[3].labels
        return self

    @staticmethod
    def _prep(feed):
        return feed.select("txn_id", "transaction_type_code", "amount",
                           F.coalesce(F.col("mcc").cast("string"), F.lit("none")).alias("mcc_s"),
                           F.log1p(F.abs("amount")).alias("log_amt"))

    def transform(self, feed):
        from pyspark.ml.feature import IndexToString
        p = self.model.transform(self._prep(feed).withColumn("category", F.lit(None).cast("string")))
        p = IndexToString(inputCol="prediction", outputCol="pred_category", labels=self.labels).transform(p)
        return p.select("txn_id", F.lit(None).cast("string").alias("canonical_merchant"),
                        F.col("pred_category").alias("category"), direction("amount").alias("direction"))


class EmbeddingRoute(Route):
    """Vocabulary vectors of the sorted train merchants; each query text takes the
    nearest name by cosine (C8); category from logistic regression on description
    vectors. ``encoder`` maps a string Column to an ARRAY<FLOAT> Column (the default
    is the 26-letter count vector, B34; a pandas_udf model encoder plugs in the same way)."""
    name = "embedding"

    def __init__(self, encoder=None):
        from merchantry.functions.text import letter_counts
        self.encoder = encoder or letter_counts

    def fit(self, train_feed, train_gold):
        from pyspark.ml import PipelineModel
        from pyspark.ml.feature import StringIndexer
        from pyspark.ml.functions import array_to_vector
        j = train_feed.select("txn_id", "description").join(
            train_gold.select("txn_id", "canonical_merchant", "category"), "txn_id")
        j = materialize(j.drop("txn_id"), "embedding_rows")
        self.vocab = (j.select(F.col("canonical_merchant").alias("name")).filter(F.col("name").isNotNull())
                      .distinct().withColumn("vec", self.encoder(F.col("name"))))
        # a text is encoded once per category; its rows are one weighted row of the regression
        indexer = StringIndexer(inputCol="category", outputCol="label_idx").fit(j)
        x = j.groupBy("description", "category").agg(F.count(F.lit(1)).cast("double").alias("weight"))
        x = materialize(x.withColumn("features", self.encoder(F.col("description"))), "embedding_weights")
        x = indexer.transform(x.withColumn("features", array_to_vector("features")))
        self.clf = PipelineModel(stages=[indexer, _logreg(j.count(), weight="weight").fit(x)])
        self.labels = indexer.labels
        return self

    def transform(self, feed):
        from pyspark.ml.feature import IndexToString
        from pyspark.ml.functions import array_to_vector
        from merchantry.operators.vectors import nearest_vector
        q = feed.select("txn_id", "amount", "description",
                        derive_canonical(strip_processor_prefix("description")).alias("query"))
        dq = q.select("query").distinct().withColumn("vec", self.encoder(F.col("query")))
        near = nearest_vector(dq, self.vocab, id_col="query")
        c = self.clf.transform(q.withColumn("features", array_to_vector(self.encoder(F.col("description"))))
                               .withColumn("category", F.lit(None).cast("string")))
        c = IndexToString(inputCol="prediction", outputCol="pred_category", labels=self.labels).transform(c)
        return (c.join(near.select("query", F.col("name").alias("canonical_merchant"), "cosine"), "query", "left")
                .select("txn_id", "canonical_merchant", F.col("pred_category").alias("category"),
                        direction("amount").alias("direction"), "cosine"))
