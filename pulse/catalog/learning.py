"""Sampling, training sets, models and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.catalog.base import COMMENTS, REGISTRY, Tables, post_time, query, quoted, sql_clean, sql_unit
from pulse.catalog.text import CLEAN, NEGATIVE, POSITIVE, class_key_terms
from pulse.functions.text import clean_tokens
from pulse.functions.timefx import in_year
from pulse.functions.values import DELETED, REMOVED
from pulse.operators import evaluation, learning, sampling, tuning
from pulse.plans import training
from pulse.sources.sinks import stage

SEED = 7


@query("U3", f"SELECT o_orderkey, o_totalprice FROM orders WHERE {sql_unit('o_orderkey')} < 0.25")
def hash_sample(t: Tables) -> DataFrame:
    return sampling.hash_sample(t.orders, "o_orderkey", 0.25).select("o_orderkey", "o_totalprice")


@query("U3")
def random_sample(t: Tables) -> DataFrame:
    return sampling.random_sample(t.orders, 0.1, 100).select("o_orderkey")


@query("U4", f"""SELECT event_id FROM events WHERE event_type <> 'purchase' AND {sql_unit('event_id')} <
(SELECT COUNT(*) FILTER (WHERE event_type = 'purchase') / COUNT(*) FILTER (WHERE event_type <> 'purchase')
 FROM events)""")
def sample_to_match(t: Tables) -> DataFrame:
    paid = F.col("event_type") == "purchase"
    return sampling.sample_to_match(
        t.events.filter(~paid), t.events.filter(paid), "event_id"
    ).select("event_id")


_BALANCE = """sizes AS (SELECT COUNT(*) FILTER (WHERE {0}) AS yes, COUNT(*) FILTER (WHERE NOT {0}) AS no
  FROM {1}), chosen AS (SELECT {1}.* FROM {1}, sizes
  WHERE {2} < CASE WHEN {0} THEN LEAST(yes, no) / yes WHEN NOT {0} THEN LEAST(yes, no) / no END)"""


@query("U5", "WITH marked AS (SELECT *, o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' AS rare FROM orders), "
       + _BALANCE.format("rare", "marked", sql_unit("o_orderkey", SEED, "balance"))
       + " SELECT o_orderkey, rare FROM chosen")
def balanced_classes(t: Tables) -> DataFrame:
    rare = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "2-HIGH")
    return sampling.balance(t.orders.withColumn("rare", rare), "rare", "o_orderkey", SEED).select(
        "o_orderkey", "rare"
    )


@query("U6", f"""SELECT event_id, CASE WHEN {sql_unit('event_id', SEED, 'split')} < 0.8 / 1.0 THEN 0
WHEN {sql_unit('event_id', SEED, 'split')} < 0.98 / 1.0 THEN 1 ELSE 2 END AS part FROM events""")
def hash_split(t: Tables) -> DataFrame:
    part = sampling.part_number(F.col("event_id"), [0.8, 0.18, 0.02], SEED)
    return t.events.select("event_id", part.alias("part"))


@query("U6")
def random_split(t: Tables) -> DataFrame:
    parts = sampling.random_split(t.events, [0.8, 0.2], 24)
    return sampling.stack(*[
        p.agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(i)) for i, p in enumerate(parts)
    ])


@query("U3", "SELECT 0 AS n_outside, 0 AS n_repeated, TRUE AS share_fits")
def random_sample_checks(t: Tables) -> DataFrame:
    """The sample is drawn from the table, without repeats, at about its fraction."""
    drawn = sampling.random_sample(t.orders, 0.1, 100).select("o_orderkey")
    known = t.orders.select("o_orderkey", F.lit(True).alias("known"))
    share = F.count(F.lit(1)) / t.orders.agg(F.count(F.lit(1))).scalar()
    return drawn.join(known, ["o_orderkey"], "left").agg(
        F.count_if(F.col("known").isNull()).cast("int").alias("n_outside"),
        (F.count(F.lit(1)) - F.count_distinct("o_orderkey")).cast("int").alias("n_repeated"),
        share.between(0.05, 0.15).alias("share_fits"))


@query("U6", "SELECT COUNT(*) AS n, COUNT(DISTINCT event_id) AS n_different, TRUE AS shares_fit FROM events")
def random_split_checks(t: Tables) -> DataFrame:
    """The parts of a random split hold every row exactly once, in about the wanted shares."""
    parts = [p.select("event_id", F.lit(i).alias("part"))
             for i, p in enumerate(sampling.random_split(t.events, [0.8, 0.2], 24))]
    return sampling.stack(*parts).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_different"),
        F.avg("part").between(0.15, 0.25).alias("shares_fit"))


_AWARD = f"""{COMMENTS}, usable AS (SELECT *, gilded >= 1 AS gilded_or_not FROM comments
  WHERE gilded IS NOT NULL AND controversiality IS NOT NULL
    AND body NOT IN ('{REMOVED}', '{DELETED}', '')
    AND NOT regexp_matches(body, 'I am a bot, and this action was performed automatically'))"""


def award_comments(t: Tables) -> DataFrame:
    """Comments whose real texts fall in both award classes: toxic labels are the awards."""
    return t.comments.withColumn("gilded", F.col("controversiality")).withColumn(
        "controversiality", (F.col("lang") == "de").cast("int")
    )


_AWARD_SET = (_AWARD.join(("WITH ", ", ")).replace(
    "gilded >= 1 AS gilded_or_not", "controversiality >= 1 AS gilded_or_not")
    + _BALANCE.format("gilded_or_not", "usable", sql_unit("id", SEED, "balance"))
    + " SELECT id, gilded_or_not, score FROM chosen")


@query("C29 P14 P6 P8 X2 U5 A20", _AWARD_SET)
def balanced_set(t: Tables) -> DataFrame:
    return training.award_set(award_comments(t), SEED).select("id", "gilded_or_not", "score")


_DELETED = f"""WITH {COMMENTS}, known AS (SELECT *, author = '{DELETED}' AS deleted FROM comments
  WHERE gilded IS NOT NULL AND controversiality IS NOT NULL AND body <> '{DELETED}'),
{_BALANCE.format('deleted', 'known', sql_unit('id', SEED, 'balance'))},
words AS (SELECT *, {sql_clean('body')} AS w, body = '{REMOVED}' AS removed_by_mod FROM chosen
  WHERE year(t) = 2021),
scored AS (SELECT *, len(list_filter(w, lambda x: x IN ({quoted(POSITIVE)})))
  - len(list_filter(w, lambda x: x IN ({quoted(NEGATIVE)}))) AS s FROM words)
SELECT id, controversiality, edited <> 'false' AS edited, gilded, is_submitter, score, stickied,
  removed_by_mod,
  CASE WHEN removed_by_mod THEN 'unknown'
       ELSE CAST(list_has_any(w, [{quoted(NEGATIVE)}]) AS VARCHAR) END AS contain_often_deleted_words,
  CASE WHEN removed_by_mod THEN 'unknown' WHEN len(w) = 0 THEN '' WHEN s > 0 THEN 'positive'
       WHEN s < 0 THEN 'negative' ELSE 'neutral' END AS sentiment_class, deleted FROM scored"""


@query("C32 U4 U5 X23 T18 X22 U1 X6 X19", _DELETED)
def deleted_set(t: Tables) -> DataFrame:
    return training.deleted_set(
        t.comments, in_year(F.col("created_utc"), 2021, epoch=True), NEGATIVE, POSITIVE, NEGATIVE, SEED
    )


def _part_sql(edges: tuple[float, ...]) -> str:
    cases = " ".join(f"WHEN {sql_unit('id', SEED, 'split')} < {edge} THEN {i}" for i, edge in enumerate(edges))
    return f"CAST(CASE {cases} ELSE {len(edges)} END AS INTEGER) AS part"


@query("C30 U5 U6 A20", f"""WITH rows AS (
{_AWARD_SET})
SELECT {_part_sql((0.8,))}, gilded_or_not, COUNT(*) AS n FROM rows GROUP BY ALL""")
def award_parts(t: Tables) -> DataFrame:
    """Rows of each class in the training and test part: both classes in both."""
    part = sampling.part_number(F.col("id"), [0.8, 0.2], SEED)
    rows = training.award_set(award_comments(t), SEED).withColumn("part", part)
    return rows.groupBy("part", "gilded_or_not").agg(F.count(F.lit(1)).alias("n"))


@query("C34 U5 U6 A20", f"""WITH rows AS ({_DELETED})
SELECT {_part_sql((0.8, 0.98))}, deleted, COUNT(*) AS n FROM rows WHERE sentiment_class <> '' GROUP BY ALL""")
def deleted_parts(t: Tables) -> DataFrame:
    """Rows of each class in the training, test and held-out part."""
    rows = deleted_set(t).filter(F.col("sentiment_class") != "")
    part = sampling.part_number(F.col("id"), [0.8, 0.18, 0.02], SEED)
    return rows.withColumn("part", part).groupBy("part", "deleted").agg(F.count(F.lit(1)).alias("n"))


@query("M1", """SELECT value, n, CAST(row_number() OVER (ORDER BY n DESC, value) - 1 AS INTEGER) AS "index"
FROM (SELECT source AS value, COUNT(*) AS n FROM documents GROUP BY 1)""")
def index_ranks(t: Tables) -> DataFrame:
    return learning.index_ranks(t.table("documents"), "source")


RULED = """SELECT toxic AS label, CAST(regexp_matches(text,
'(?i)worthless|idiot|trash|moron|clown|pathetic') AS INTEGER) AS prediction
FROM labels JOIN documents USING (doc_id)"""


def ruled_predictions(t: Tables) -> DataFrame:
    """Predictions made by a rule: toxic when the text holds a listed word."""
    hit = F.col("body").rlike("(?i)worthless|idiot|trash|moron|clown|pathetic").cast("int")
    texts = t.posts.select("id", hit.alias("prediction"))
    return texts.join(
        t.labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("label")), ["id"]
    ).select("label", "prediction")


@query("E1", f"""WITH c AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
  COUNT(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
  COUNT(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
  COUNT(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn FROM ({RULED}))
SELECT n, (tp + tn) / n AS accuracy, 1 - (tp + tn) / n AS test_error,
  ((tp + fn) * ((2 * tp) / (2 * tp + fp + fn)) + (tn + fp) * ((2 * tn) / (2 * tn + fn + fp))) / n AS f1,
  (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy FROM c""")
def rule_report(t: Tables) -> DataFrame:
    return evaluation.binary_report(ruled_predictions(t), "label", "prediction")


_SCORED = """SELECT toxic AS label, n_chars % 97 + 40 * toxic AS score FROM labels JOIN documents USING (doc_id)
WHERE toxic IS NOT NULL"""


@query("E1 E4", f"""WITH s AS ({_SCORED}), r AS (
  SELECT label, rank() OVER (ORDER BY score) + (COUNT(*) OVER (PARTITION BY score) - 1) / 2 AS place FROM s),
sizes AS (SELECT COUNT(*) FILTER (WHERE label = 1) AS yes, COUNT(*) FILTER (WHERE label = 0) AS no FROM s)
SELECT round((SUM(place) FILTER (WHERE label = 1) - any_value(yes) * (any_value(yes) + 1) / 2)
  / (any_value(yes) * any_value(no)), 9) AS auc FROM r, sizes""")
def score_auc(t: Tables) -> DataFrame:
    """Area under the curve of a score with ties, which follows the label loosely."""
    rows = t.posts.select("id", "score").join(
        t.labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("label")), ["id"])
    score = F.col("score") % 97 + 40 * F.col("label")
    return evaluation.area_under_roc(rows, "label", score).select(F.round("auc", 9).alias("auc"))


@query("E2", f"SELECT label, prediction, COUNT(*) AS n FROM ({RULED}) GROUP BY ALL")
def rule_confusion(t: Tables) -> DataFrame:
    return evaluation.confusion(ruled_predictions(t), "label", "prediction")


@query("E3", f"""SELECT label, COUNT(*) AS n, AVG(CAST(label = prediction AS INTEGER)) AS class_accuracy
FROM ({RULED}) GROUP BY 1""")
def rule_class_accuracy(t: Tables) -> DataFrame:
    return evaluation.class_accuracy(ruled_predictions(t), "label", "prediction")


def award_rows(t: Tables) -> DataFrame:
    balanced = training.award_set(award_comments(t), SEED)
    rows = training.award_features(balanced, post_time(), POSITIVE, NEGATIVE)
    return stage(rows.hint("rebalance"), t.scratch("award"))


#: Searches of this session by application, folder and model: queries on the same tables share them.
_SEARCHES: dict[tuple[str, str, str], tuning.Search] = {}


def _searched(t: Tables, kinds: tuple[str, ...]) -> tuple[dict[str, tuning.Search], DataFrame]:
    """The published grids searched whole, and the test rows."""
    train, test = sampling.hash_split(award_rows(t), [0.8, 0.2], "id", SEED)
    keys = {k: (t.spark.sparkContext.applicationId, t.folder, k) for k in kinds}
    for kind, key in keys.items():
        if key not in _SEARCHES:
            _SEARCHES[key] = training.award_search(train, kind)
    return {k: _SEARCHES[key] for k, key in keys.items()}, test


def _compared(t: Tables, kinds: tuple[str, ...]) -> DataFrame:
    """Quality of the best models, with the size of their grids."""
    found, test = _searched(t, kinds)
    sizes = F.create_map(*[F.lit(x) for k, s in found.items() for x in (k, len(s.settings))])
    report = training.model_comparison({k: s.model for k, s in found.items()}, test)
    return report.withColumn("n_settings", F.element_at(sizes, F.col("model")))


@query("C30 M1 M2 M3 M4 M5 M6 M9 M10 M11 E1 E4")
def clf_features(t: Tables) -> DataFrame:
    return _compared(t, ("forest", "logistic"))


@query("C31 T12 M5 M7 M10 E1 E4")
def clf_text(t: Tables) -> DataFrame:
    return _compared(t, ("svm", "text_forest"))


_GRID_SIZES = (("forest", 120), ("logistic", 36), ("svm", 3), ("text_forest", 27))


@query("C30 C31 M10", f"""WITH rows AS ({_AWARD_SET}), grids(model, n_settings) AS (VALUES {
    ', '.join(map(str, _GRID_SIZES))})
SELECT model, n_settings, CAST(gilded_or_not AS INTEGER) AS label, COUNT(*) AS n FROM rows, grids
WHERE {sql_unit('id', SEED, 'split')} >= 0.8 GROUP BY ALL""")
def search_sizes(t: Tables) -> DataFrame:
    """Settings tried by the published search of all four models, and test rows that the best one predicted, by class."""
    found, test = _searched(t, ("forest", "logistic", "svm", "text_forest"))
    return sampling.stack(*[
        s.model.transform(test).where(F.col("prediction").isNotNull()).groupBy(F.col("gilded_or_not").alias("label")).agg(
            F.count(F.lit(1)).alias("n")).withColumns({"model": F.lit(k), "n_settings": F.lit(len(s.settings))})
        for k, s in found.items()])


def deleted_rows(t: Tables) -> DataFrame:
    rows = training.deleted_set(
        t.comments, in_year(F.col("created_utc"), 2021, epoch=True), NEGATIVE, POSITIVE, NEGATIVE, SEED
    )
    return stage(rows.hint("rebalance"), t.scratch("deleted"))


@query("C34 C35 U6 M5 M7 M8 E1 E4")
def clf_deleted(t: Tables) -> DataFrame:
    train, test, _ = training.deleted_splits(deleted_rows(t), SEED)
    return training.model_comparison(training.deleted_models(train), test)


@query("C35 E5 E6 E7 W5")
def importance_scaled(t: Tables) -> DataFrame:
    train, test, _ = training.deleted_splits(deleted_rows(t), SEED)
    return training.importance_comparison(training.deleted_models(train), test)


@query("E6")
def importance_ranked(t: Tables) -> DataFrame:
    """The features of one model by falling importance."""
    train, test, _ = training.deleted_splits(deleted_rows(t), SEED)
    model = training.deleted_models(train, ["forest"])["forest"]
    return evaluation.ranked_importances(evaluation.importances(model.transform(test), learning.classifier_of(model)))


@query("C35 E2 E3 M4")
def model_class_accuracy(t: Tables) -> DataFrame:
    train, test, _ = training.deleted_splits(deleted_rows(t), SEED)
    model = training.deleted_models(train, ["forest"])["forest"]
    scored = model.transform(test).withColumn("deleted", F.col("deleted").cast("string"))
    return evaluation.class_accuracy(scored, "deleted", "predicted")


@query("C36 M12 O4")
def model_round_trip(t: Tables) -> DataFrame:
    train, test, _ = training.deleted_splits(deleted_rows(t), SEED)
    model = training.deleted_models(train, ["boosted"])["boosted"]
    again = learning.load_model(learning.save(model, t.scratch("model")))
    return again.transform(test).select("id", "deleted", "predicted").orderBy("id").limit(10)


@query("C36 M12", f"""WITH rows AS ({_DELETED})
SELECT COUNT(*) AS n, CAST(0 AS BIGINT) AS n_different FROM rows WHERE sentiment_class <> ''
AND {sql_unit('id', SEED, 'split')} >= 0.8 AND {sql_unit('id', SEED, 'split')} < 0.98""")
def model_round_trip_equal(t: Tables) -> DataFrame:
    """A saved and loaded model predicts every test row as before."""
    train, test, _ = training.deleted_splits(deleted_rows(t), SEED)
    model = training.deleted_models(train, ["forest"])["forest"]
    again = learning.load_model(learning.save(model, t.scratch("model")))
    before = model.transform(test).select("id", F.col("predicted").alias("before"))
    return before.join(again.transform(test).select("id", "predicted"), ["id"]).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("before") != F.col("predicted")).alias("n_different"))


@query("T18 C32", f"""WITH top AS ({REGISTRY["class_key_terms"].sql}), {CLEAN.removeprefix("WITH ")}
SELECT id, list_has_any(w, (SELECT list(term) FROM top)) AS contains_frequent FROM clean""")
def class_word_flag(t: Tables) -> DataFrame:
    """Flag texts with any of the 30 words that most often mark the deleted class."""
    frequent = class_key_terms(t).agg(F.collect_list("term")).scalar()
    return t.posts.select(
        "id", F.arrays_overlap(clean_tokens(F.col("body")), frequent).alias("contains_frequent"))
