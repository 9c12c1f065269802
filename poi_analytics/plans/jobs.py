"""Batch jobs (the command-line surface): ODS load, DWD build, marts, summaries, training, embeddings.

A mart job writes the columns a family reads (for the pages, JSON-parsed) once to a folder under its
output and builds every mart from those files, so N marts cost one scan of the DWD table and
a lost executor re-reads files.  The folder goes when the job is done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import columns_of
from ..operators import clean, similarity
from ..operators import interactions as inter
from ..session import materialized, remove
from ..sinks import models, writers
from ..sources import landing
from . import home, pages, recommend, screen
from .schemas import SCHEMAS


def load_ods(spark: SparkSession, csv_path: str, target: str, mode: str = "overwrite",
             repartition: int | None = None, as_table: bool = False) -> None:
    """A1 + B1: landing CSV -> ODS Parquet layer."""
    writers.write_layer(landing.read_landing_csv(spark, csv_path), target, mode, repartition, as_table)


def build_dwd(ods: DataFrame, target: str, mode: str = "overwrite", repartition: int | None = None,
              as_table: bool = False) -> None:
    """C1-C5 + B1: ODS -> DWD layer."""
    writers.write_layer(clean.clean(ods), target, mode, repartition, as_table)


FAMILIES = {"screen": (screen, None), "home": (home, None), "pages": (pages, pages.prepare)}
#: The mart whose length the caller sets.
TOPN_MART = {"screen": "screen_top_table", "home": "home_featured"}

# The published keys of the summary documents.
SCREEN_KEYS = {"cards": "screen_cards", "mapHeat": "screen_map_heat", "wordCloud": "screen_word_cloud",
               "scoreTrend": "screen_score_trend", "categoryBreakdown": "screen_category",
               "scoreDistribution": "screen_score_distribution", "priceRange": "screen_price_range",
               "topTable": "screen_top_table", "recommendations": "screen_recommendations"}
HOME_KEYS = {"cards": "home_cards", "cityOverview": "home_city_overview", "categoryMatrix": "home_category_matrix",
             "priceTrend": "home_price_trend", "recentTrend": "home_recent_trend", "hotTags": "home_hot_tags",
             "featuredList": "home_featured"}
PAGE_GROUPS = ("filter", "price", "family", "media")
#: Rows grow with the cities, so it is published as rows and not in the document.
UNBOUNDED = ("recentTrend",)


def build_marts(df: DataFrame, family: str, topn: int | None = None) -> dict[str, DataFrame]:
    """Every mart of a family over its (prepared) input; ``topn`` sets the family's own listing."""
    marts = {name: fn(df) for name, fn in FAMILIES[family][0].BUILDERS.items()}
    if topn and family in TOPN_MART:
        name = TOPN_MART[family]
        marts[name] = FAMILIES[family][0].BUILDERS[name](df, topn)
    return marts


def shared_input(dwd: DataFrame, family: str) -> DataFrame:
    """The family's input columns that ``dwd`` has, prepared."""
    module, prepare = FAMILIES[family]
    own = dwd.select(*dict.fromkeys(columns_of(dwd, module.INPUT_COLUMNS)))
    return prepare(own) if prepare else own


def run_marts(dwd: DataFrame, family: str, out_dir: str, as_table: bool = False,
              topn: int | None = None) -> dict[str, str]:
    """Build and write every mart of ``family`` ('screen', 'home' or 'pages') with its declared schema.

    Returns {mart name: target}.
    """
    path = f"{out_dir.rstrip('/')}/_input_{family}"
    try:
        shared = materialized(shared_input(dwd, family), family, path)
        targets = {}
        for name, mart in build_marts(shared, family, topn).items():
            targets[name] = name if as_table else f"{out_dir.rstrip('/')}/{name}"
            writers.write_mart(mart, targets[name], SCHEMAS[name], as_table=as_table)
    finally:
        remove(dwd.sparkSession, path)
    return targets


def summary(df: DataFrame, family: str, topn: int | None = None, generated_at: str | None = None) -> DataFrame:
    """The family's summary document over its (prepared) input, in the published shape."""
    marts = {n: writers.conform(m, SCHEMAS[n]) for n, m in build_marts(df, family, topn).items()}
    if family == "pages":
        sections = {g: {n.removeprefix("pages_"): m for n, m in marts.items() if PAGE_GROUP[n] == g} for g in PAGE_GROUPS}
        return writers.summary_document(sections, generated_at=generated_at)
    keys = SCREEN_KEYS if family == "screen" else HOME_KEYS
    return writers.summary_document({k: marts[n] for k, n in keys.items() if k not in UNBOUNDED}, ("cards",), generated_at)


PAGE_GROUP = {n: "price" if n == "pages_paid_rate" else n.split("_")[1] for n in pages.BUILDERS}


def run_summary(dwd: DataFrame, family: str, path: str, topn: int | None = None) -> None:
    """The summary document under ``path``/document, and unbounded marts as rows under ``path``/rows."""
    scratch = f"{path.rstrip('/')}/_input"
    try:
        shared = materialized(shared_input(dwd, family), family, scratch)
        writers.write_summary(summary(shared, family, topn), f"{path.rstrip('/')}/document")
        if family == "home":
            rows = {HOME_KEYS[k]: build_marts(shared, family)[HOME_KEYS[k]] for k in UNBOUNDED}
            writers.summary_rows(rows).write.mode("overwrite").json(f"{path.rstrip('/')}/rows")
    finally:
        remove(dwd.sparkSession, scratch)


def train_recommenders(interactions: DataFrame, dwd: DataFrame, out_dir: str) -> None:
    """L1-L11 + B5: fit both models, publish them as new versions and write indexes and item features under ``out_dir``."""
    pos, users, items = inter.indexed_positives(inter.interactions_with_items(interactions, dwd))
    features = inter.item_features(dwd, items)
    frame = inter.ctr_training_frame(inter.training_set(pos, inter.negative_samples(
        pos, ratio=inter.CTR_NEG_RATIO, seed=recommend.SEED)), features)
    factors = recommend.cf_train(pos)
    ranker = recommend.ctr_train(materialized(frame, "ctr-frame"), factors)
    out = out_dir.rstrip("/")
    for name, model in (("cf", factors), ("ctr", ranker)):
        models.save_version(model, f"{out}/{name}", dwd.sparkSession)
    for name, df in (("users", users), ("items", items), ("item_features", inter.ctr_item_features(features))):
        writers.write_factors(df, f"{out}/{name}")


def build_embeddings(texts: DataFrame, path: str, make_model: Callable | None = None,
                     id_col: str = "poi_id", text_col: str = "text", dim: int = similarity.TEXT_DIM) -> None:
    """L17 + B5: (poi_id, vector) of every text, by a caller's model or by native text hashing."""
    if make_model is None:
        vectors = similarity.text_vector_dense(texts, id_col, text_col, dim)
    else:
        vectors = texts.select(texts[id_col].alias("poi_id"),
                               recommend.embed_batch(texts[text_col], make_model, dim).alias("vector"))
    writers.write_factors(vectors, path)
