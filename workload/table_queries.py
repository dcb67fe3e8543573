"""Queries over the feature matrix and the survey, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccadia.functions.scalars import excel_date
from saccadia.operators import event_features, matrix, stats, survey
from workload import ctes, inputs
from workload.event_queries import rounded_doubles
from workload.sqltools import query, rounded

SPARK: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        SPARK[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return keep


FEATURES = ["click_mean", "click_max", "view_mean", "view_std", "error_min", "purchase_sum", "value_mean", "value_twin",
            "n_events", "constant"]


def features(spark, sf) -> DataFrame:
    return inputs.user_features(spark, sf)


def long(spark, sf) -> DataFrame:
    return matrix.long_view(features(spark, sf), FEATURES)


# --- matrix ----------------------------------------------------------------------------------------------------------

@register("demographics", query(ctes.USERS, """
select participant_id, cast(grp = 'PATIENT' as int) as y, cast(cast(date '1899-12-30' + cast(visit as int) as date) as varchar) as visit_date
 from users where visit is not null"""))
def demographics(spark, sf):
    people = inputs.demographics(spark, sf)
    dates = people.select(F.col("ID").alias("participant_id"), excel_date(F.col("Eye tracking date")).cast("string").alias("visit_date"))
    return matrix.demographics(people).join(dates, "participant_id")


def _mean_features(spark, sf, experiment: str) -> DataFrame:
    rows = inputs.prepared_events(spark, sf, experiment)
    return event_features.mean_metrics(rows).select("experiment", "participant_id", "mean_duration_sacc",
                                                    "mean_duration_fix")


MEANS = """select participant_id, avg(case when event = 'ESACC' then duration end) as s,
 avg(case when event = 'EFIX' then duration end) as f from prep group by all"""


@register("feature_matrix", f"""
with a as ({query(ctes.prepared('SHAPES'), MEANS)}),
b as ({query(ctes.prepared('REACTION'), MEANS)})
select participant_id, round(a.s, 6) as SHAPES_mean_duration_sacc, round(a.f, 6) as SHAPES_mean_duration_fix,
 round(b.s, 6) as REACTION_mean_duration_sacc, round(b.f, 6) as REACTION_mean_duration_fix
 from a full join b using (participant_id)""")
def feature_matrix(spark, sf):
    return rounded_doubles(matrix.feature_matrix({e: _mean_features(spark, sf, e) for e in ("SHAPES", "REACTION")}))


@register("matrix_labelled", f"""
with {ctes.USERS.strip()},
a as ({query(ctes.prepared('REACTION'), MEANS)})
select participant_id, cast(grp = 'PATIENT' as int) as y, round(a.s, 6) as REACTION_mean_duration_sacc,
 round(a.f, 6) as REACTION_mean_duration_fix from users left join a using (participant_id) where visit is not null""")
def matrix_labelled(spark, sf):
    table = matrix.feature_matrix({"REACTION": _mean_features(spark, sf, "REACTION")})
    return rounded_doubles(matrix.labelled_matrix(table, matrix.demographics(inputs.demographics(spark, sf))))


@register("features_with_people", f"""
with {ctes.USERS.strip()},
a as ({query(ctes.prepared('REACTION'), MEANS)})
select participant_id, cast(grp = 'PATIENT' as int) as y, round(a.s, 6) as mean_duration_sacc
 from a left join users using (participant_id)""")
def features_with_people(spark, sf):
    people = matrix.demographics(inputs.demographics(spark, sf), require_visit=False)
    rows = _mean_features(spark, sf, "REACTION").select("participant_id", "mean_duration_sacc")
    return rounded_doubles(matrix.with_demographics(rows, people))


@register("long_view", query(ctes.USER_FEATURES, "select participant_id, y, feature, round(value, 6) as value from lf"))
def long_view(spark, sf):
    return rounded_doubles(long(spark, sf))


@register("complete_rows", query(ctes.USER_FEATURES, f"""
select participant_id, y, {rounded('click_mean', 'view_std', 'error_min')} from uf
 where click_mean is not null and view_std is not null and error_min is not null"""))
def complete_rows(spark, sf):
    rows = features(spark, sf).select("participant_id", "y", "click_mean", "view_std", "error_min")
    return rounded_doubles(matrix.drop_incomplete_rows(rows))


@register("rows_with_any_feature", query(ctes.GAZE, """
select participant_id, trial_id, seq, x, y, stimulus_x from gaze where x is not null or y is not null
 or stimulus_x is not null"""))
def rows_with_any_feature(spark, sf):
    rows = inputs.gaze_events(spark, sf, "SHAPES").select("participant_id", "trial_id", "seq", "x", "y", "stimulus_x")
    return matrix.drop_empty_rows(rows, ["x", "y", "stimulus_x"])


@register("complete_columns", query(ctes.USER_FEATURES, """
select participant_id, feature, round(value, 6) + 0.0::double as value from lf where feature in (
 select feature from lf group by feature having count(*) = (select count(*) from uf))"""))
def complete_columns(spark, sf):
    """Features that nobody lacks."""
    rows = matrix.drop_incomplete_columns(features(spark, sf).drop("y"), ["participant_id"])
    return rounded_doubles(matrix.long_view(rows, [c for c in rows.columns if c != "participant_id"], ["participant_id"]))


# --- filters and tests -----------------------------------------------------------------------------------------------

@register("low_variance", query(ctes.USER_FEATURES, """
select feature, round(min(value), 6) as low, round(max(value), 6) as high,
 round(var_pop(value) / nullif((max(value) - min(value)) ** 2, 0), 6) as variance,
 coalesce(var_pop(value) / nullif((max(value) - min(value)) ** 2, 0) > 0.01, false) as is_kept from lf group by feature"""))
def low_variance(spark, sf):
    kept = F.coalesce(F.col("variance") > 0.01, F.lit(False))
    return rounded_doubles(stats.feature_variance(long(spark, sf)).withColumn("is_kept", kept))


@register("scaled_features", query(ctes.USER_FEATURES + """,
r as (select feature, min(value) as low, max(value) as high, var_pop(value) / nullif((max(value) - min(value)) ** 2, 0) as v from lf group by feature)""", """
select participant_id, feature, round((value - low) / (high - low), 6) + 0.0::double as value from lf join r using (feature) where v > 0.01"""))
def scaled_features(spark, sf):
    """Features that vary enough, scaled to [0, 1]."""
    scaled, kept = stats.remove_low_variance(features(spark, sf), FEATURES)
    return rounded_doubles(matrix.long_view(scaled, kept, ["participant_id"]))


PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]]


@register("corr_pairs", query(ctes.USER_FEATURES + """,
pairs as (select a.feature as f1, b.feature as f2, corr(a.value, b.value) as r, stddev_pop(a.value) as sa,
 stddev_pop(b.value) as sb from lf a join lf b on a.participant_id = b.participant_id and a.feature <> b.feature group by all)""",
                              f"""
select f1, f2, case when sa > 1e-9 and sb > 1e-9 then round(r, 6) + 0.0::double end as corr from pairs
 where (f1, f2) in ({', '.join(str(p) for p in PAIRS)})"""))
def corr_pairs(spark, sf):
    return rounded_doubles(stats.pairwise_correlation(features(spark, sf), FEATURES))


@register("collinear_pairs", query(ctes.USER_FEATURES, f"""
select f1, f2 from (select a.feature as f1, b.feature as f2, corr(a.value, b.value) as r, stddev_pop(a.value) as sa,
 stddev_pop(b.value) as sb from lf a join lf b on a.participant_id = b.participant_id and a.feature <> b.feature
 group by all) p where (f1, f2) in ({', '.join(str(p) for p in PAIRS)}) and sa > 1e-9 and sb > 1e-9 and abs(r) > 0.85"""))
def collinear_pairs(spark, sf):
    return stats.pairwise_correlation(features(spark, sf), FEATURES).where(F.abs("corr") > 0.85).select("f1", "f2")


#: The greedy walk as a recursion: its state is the list of dropped names.
WALK = ctes.USER_FEATURES + f""",
strength as (select feature, case when stddev_pop(value) > 1e-9 then abs(corr(value, y)) end as s, var_samp(value) as v from lf group by feature),
named as (select unnest({FEATURES!r}) as feature, generate_subscripts({FEATURES!r}, 1) as pos),
ranked as (select feature, row_number() over (order by coalesce(s, -1) desc, coalesce(v, 0) desc, pos) as i from named left join strength using (feature)),
close as (select f2 as feature, list(f1) as before from (select a.feature as f1, b.feature as f2, corr(a.value, b.value) as r,
 stddev_pop(a.value) as sa, stddev_pop(b.value) as sb from lf a join lf b on a.participant_id = b.participant_id and a.feature <> b.feature
 group by all) p where (f1, f2) in ({', '.join(str(p) for p in PAIRS)}) and sa > 1e-9 and sb > 1e-9 and abs(r) > 0.85 group by f2),
walk as (with recursive w as (
 select cast(0 as bigint) as i, cast([] as varchar[]) as dropped
 union all select w.i + 1, case when list_contains(dropped, feature) then dropped
  else list_distinct(list_concat(dropped, coalesce(before, cast([] as varchar[])))) end
 from w join ranked r on r.i = w.i + 1 left join close using (feature)) select dropped from w order by i desc limit 1)"""


@register("drop_collinear", query(WALK, """
select participant_id, y, feature, round(value, 6) + 0.0::double as value from lf, walk where not list_contains(dropped, feature)"""))
def drop_collinear(spark, sf):
    reduced, kept = stats.remove_collinear(features(spark, sf), FEATURES)
    return rounded_doubles(matrix.long_view(reduced, kept, ["participant_id", "y"]))


@register("mad_outliers", query(ctes.USER_FEATURES + """,
med as (select feature, median(value) as m from lf group by feature),
mad as (select feature, any_value(m) as m, median(abs(value - m)) as d from lf join med using (feature) group by feature)""", """
select participant_id, y, feature, case when not (d > 0 and abs(value - m) > 3 * d) then round(value, 6) end as value
 from lf join mad using (feature)"""))
def mad_outliers(spark, sf):
    return rounded_doubles(stats.mark_outliers(long(spark, sf), 3.0))


@register("outlier_limits", query(ctes.USER_FEATURES + """,
med as (select feature, median(value) as m from lf group by feature)""", """
select feature, round(any_value(m), 6) as median, round(median(abs(value - m)), 6) as mad
 from lf join med using (feature) group by feature"""))
def outlier_limits(spark, sf):
    return rounded_doubles(stats.outlier_limits(long(spark, sf)))


@register("low_target_corr", query(ctes.USER_FEATURES, """
select feature, round(corr(value, y), 6) as corr from lf group by feature
 having abs(corr(value, y)) < 0.1"""))
def low_target_corr(spark, sf):
    return rounded_doubles(stats.low_target_correlation(long(spark, sf)))


RANKED = """,
ranked as (select feature, y, value, rank() over (partition by feature order by value)
  + (count(*) over (partition by feature, value) - 1) / 2 as r from {source}),
ties as (select feature, sum(t * t * t - t) as tie from (select feature, value, cast(count(*) as double) as t
  from {source} group by all) c group by feature),
tested as (select feature, count(*) filter (where y = 0) as n0, count(*) filter (where y = 1) as n1,
 sum(r) filter (where y = 0) as r0, avg(value) filter (where y = 0) as m0, avg(value) filter (where y = 1) as m1,
 stddev_pop(value) filter (where y = 0) as s0, stddev_pop(value) filter (where y = 1) as s1 from ranked group by feature),
u as (select *, r0 - n0 * (n0 + 1) / 2 as uv from tested join ties using (feature))"""
#: Two-sided normal tail of z, by the series of the error function.
TAIL = """case when z is null then null when z <= 0 then 1.0 else 1 - 2 / sqrt(pi()) * exp(-z * z / 2) * list_sum(list_transform(range(0, 400), lambda i:
 exp(i * ln(2.0) + (2 * i + 1) * ln(z / sqrt(2.0)) - (lgamma(2.0 * i + 2) - i * ln(2.0) - lgamma(i + 1.0))))) end"""
MANN = f"""
select * replace (round(z, 6) as z), round({TAIL}, 6) + 0.0::double as p_value from ("""+"""
select feature, round(uv, 6) as U_value, n0 as n_control, n1 as n_patient,
 (greatest(uv, n0 * n1 - uv) - n0 * n1 / 2 - 0.5) / nullif(sqrt(n0 * n1 / 12 * (n0 + n1 + 1 - tie / ((n0 + n1)
  * (n0 + n1 - 1)))), 0) as z, round(m0, 6) as mean_control, round(m1, 6) as mean_patient, round(s0, 6) as std_control,
 round(s1, 6) as std_patient from u) t"""


@register("mann_whitney", query(ctes.USER_FEATURES + RANKED.format(source="lf"), MANN))
def mann_whitney(spark, sf):
    return rounded_doubles(stats.mann_whitney(long(spark, sf)))


DOC_TESTS = """
docs as (select d.doc_id as participant_id, l.quality as y, 'n_chars' as feature, cast(n_chars as double) as value
  from documents d join labels l using (doc_id) where l.quality is not null
 union all select d.doc_id, l.quality, 'n_words', cast(len(string_split(text, ' ')) as double)
  from documents d join labels l using (doc_id) where l.quality is not null)"""


def doc_features(spark, sf, label: str = "quality") -> DataFrame:
    docs = inputs.table(spark, sf, "documents").select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.size(F.split("text", " ")).cast("double").alias("n_words"))
    labels = inputs.table(spark, sf, "labels").where(f"{label} is not null").select("doc_id", F.col(label).alias("y"))
    return docs.join(labels, "doc_id").withColumnRenamed("doc_id", "participant_id")


@register("mann_whitney_documents", query(DOC_TESTS + RANKED.format(source="docs"), MANN))
def mann_whitney_documents(spark, sf):
    return rounded_doubles(stats.mann_whitney(matrix.long_view(doc_features(spark, sf))))


@register("t_test", query(ctes.USER_FEATURES + """,
g as (select feature, count(*) filter (where y = 0) as n0, count(*) filter (where y = 1) as n1,
 avg(value) filter (where y = 0) as m0, avg(value) filter (where y = 1) as m1,
 var_samp(value) filter (where y = 0) as v0, var_samp(value) filter (where y = 1) as v1 from lf group by feature)""", """
select feature, round(t, 6) as t_value, df, round(case when t = 0 then 1.0 else 1 - exp(0.5 * ln(x) + df / 2 * ln(1 - x) - ln(0.5)
  - lgamma(0.5) - lgamma(df / 2) + lgamma(0.5 + df / 2)) * list_sum(list_transform(range(0, 3000), lambda i: exp(lgamma(0.5 + df / 2 + i)
  - lgamma(0.5 + df / 2) + lgamma(1.5) - lgamma(1.5 + i) + i * ln(x)))) end, 6) + 0.0::double as p_value
 from (select *, t * t / (df + t * t) as x from (select feature, n0 + n1 - 2 as df,
 (m0 - m1) / nullif(sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1 / n0 + 1 / n1)), 0) as t from g) a) b"""))
def t_test(spark, sf):
    return rounded_doubles(stats.t_test(long(spark, sf)))


@register("bh_adjust", """
with p as (select event_type || strftime(ts, '%Y-%m-%d') as feature, avg(value) / 100 as p_value from events group by all),
r as (select *, count(*) over () as m, row_number() over (order by p_value, feature) as i from p),
a as (select feature, p_value, least(1.0, min(p_value * m / i) over (order by i desc)) as q from r)
select feature, round(p_value, 6) as p_value, round(q, 6) as p_value_corrected, q <= 0.25 as is_significant from a""")
def bh_adjust(spark, sf):
    """A mean per event type and day stands for the p-value of a feature."""
    feature = F.concat("event_type", F.date_format("ts", "yyyy-MM-dd")).alias("feature")
    tests = (inputs.table(spark, sf, "events").groupBy(feature)
             .agg((F.avg("value") / 100).alias("p_value")))
    return rounded_doubles(stats.benjamini_hochberg(tests, 0.25))


@register("significant_features", query(DOC_TESTS.replace("l.quality", "l.toxic") + RANKED.format(source="docs"), f"""
select feature, round(p_value, 6) as p_value, round(q, 6) as p_value_corrected from (
 select *, least(1.0, min(p_value * m / i) over (order by i desc)) as q from (
 select *, count(*) over () as m, row_number() over (order by p_value, feature) as i from ({MANN.replace("round(" + TAIL + ", 6)", TAIL)}) a) b) c
 where q <= 0.9"""))
def significant_features(spark, sf):
    """Features of the documents by their label; the level lets some through at every size."""
    found = stats.significant_features(matrix.long_view(doc_features(spark, sf, "toxic")), 0.9)
    return rounded_doubles(found.select("feature", "p_value", "p_value_corrected"))


# --- survey ----------------------------------------------------------------------------------------------------------

LATEST = ctes.SURVEY + """,
latest as (select * exclude (i) from (select *, row_number() over (partition by id order by date desc nulls last, seq desc)
 as i from survey) s where i = 1)"""


def latest(spark, sf) -> DataFrame:
    return survey.latest_per_id(inputs.survey(spark, sf), ties=["seq"])


@register("survey_latest", query(LATEST, "select id, seq, category, q0_a, q2 from latest"))
def survey_latest(spark, sf):
    return latest(spark, sf).select("id", "seq", "category", "q0_a", "q2")


@register("survey_coalesce", query(ctes.SURVEY, """
select id, seq, coalesce(q0_a, q0_b) as q0_a, case category when 'PATIENT' then 1 else 0 end as category from survey"""))
def survey_coalesce(spark, sf):
    merged = survey.merge_questions(inputs.survey(spark, sf), {"q0_a": ["q0_a", "q0_b"]})
    return survey.category_code(merged).select("id", "seq", "q0_a", "category")


@register("rename_topics", query(ctes.SURVEY, """
select id, seq, q0_a as "vision:0", q2 as "reading:2" from survey"""))
def rename_topics(spark, sf):
    rows = inputs.survey(spark, sf).select("id", "seq", F.col("q0_a").alias("vision:0_Do lines_blur?"),
                                           F.col("q2").alias("reading:2_How long?"))
    return survey.rename_topics(rows, ["id", "seq"])


@register("drop_sparse_cols", query(LATEST, "select * exclude (q1_sparse, q0_b, date) from latest"))
def drop_sparse_cols(spark, sf):
    return matrix.drop_sparse_columns(latest(spark, sf), 0.60).drop("date")


@register("drop_sparse_rows", query(LATEST, """
select id, seq, q0_a, q0_b, q1_sparse, q2 from latest where cast(q0_a is null as int) + cast(q0_b is null as int)
 + cast(q1_sparse is null as int) + cast(q2 is null as int) <= 2"""))
def drop_sparse_rows(spark, sf):
    return matrix.drop_sparse_rows(latest(spark, sf).select("id", "seq", "q0_a", "q0_b", "q1_sparse", "q2"), 0.34)


@register("multi_hot", query(ctes.SURVEY, "select id, seq, " + ", ".join(
    f"cast(contains(pain, '''{c}''') as int) as \"pain:{c}\"" for c in "01234") + """,
 cast(contains(pain, '''5''') as int) as "pain:5" from survey"""))
def multi_hot(spark, sf):
    rows = inputs.survey(spark, sf).select("id", "seq", "pain")
    return survey.multi_hot(rows, "pain", "pain:", codes=list("012345"))


@register("topic_totals", query(ctes.SURVEY, "select id, " + " + ".join(
    f"cast(sum(cast(contains(pain, '''{c}''') as int)) as bigint)" for c in "012345") + """ as pain,
 cast(count(*) as bigint) as reading from survey group by id"""))
def topic_totals(spark, sf):
    """Answers per topic; the columns of a topic are found by its name."""
    rows = survey.multi_hot(inputs.survey(spark, sf).select("id", "pain"), "pain", "pain:", codes=list("012345")).withColumn("reading:0", F.lit(1))
    topics = survey.topic_columns([c for c in rows.columns if c != "id"])
    return rows.groupBy("id").agg(*[sum((F.sum(f"`{c}`") for c in columns), F.lit(0)).alias(t) for t, columns in topics.items()])
