"""Queries of scans, records, insights, evaluation, bots and text steps, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from opinara import schema as S
from opinara.functions import lexicon, text as X
from opinara.functions.numbers import percent, rounded as r4
from opinara.operators import agreement, bots as B, escalation as E, evaluation as V, insights as I, languages as L, phrases as P, records as R, trends as T, vocabulary, weekly as W
from opinara.operators.ordering import positions
from opinara.plans import catalog as C, oracle as O
from opinara.plans.catalog import STOP_TEST
from opinara.plans.views import document_reviews, event_reviews, line_reviews, table
from opinara.sources import responses, scans, sinks, snapshots, splittable
from opinara.storage import fresh_path
from opinara.streaming import lifecycle

QUERIES, SQL = {}, {}
_EV, _DOC, _RV, _r, _LIST = O._EV, O._DOC, O._RV, O._r, O._LIST
#: A query's SQL as a subquery.
of = lambda name: f"({O.SQL.get(name) or SQL[name]})"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# scans


@query(f"WITH {_EV} SELECT review_id, rating FROM ev WHERE product_name = 'P1' AND rating <= 2")
def bound_scan(spark, d):
    return scans.scan(spark, "SELECT review_id, rating FROM {rows} WHERE product_name = :product AND rating <= :most", event_reviews(spark, d), product="P1", most=2)


def _labelled(spark, d):
    rows = event_reviews(spark, d)
    item = lambda k, s: F.concat(F.lit('{"feature":"F'), k, F.lit('","sentiment":"'), s, F.lit('"}'))
    raw = F.concat(F.lit("["), item(F.col("feature_no"), F.col("sentiment")), F.lit(","), item(F.col("user_id") % 3, F.lit("negative")), F.lit("]"))
    return scans.with_manual_features(rows.select("review_id", "feature_no", "user_id", "sentiment", F.when(F.col("user_id") % 11 == 0, "no json").otherwise(raw).alias("manual_features")))


@query(f"""WITH {_EV}, f AS (SELECT 'F' || feature_no AS feature, sentiment FROM ev WHERE user_id % 11 <> 0 UNION ALL SELECT 'F' || (user_id % 3), 'negative' FROM ev WHERE user_id % 11 <> 0)
SELECT feature, sentiment, count(*) AS labels FROM f GROUP BY 1, 2""")
def labelled_features(spark, d):
    return _labelled(spark, d).select(F.explode("manual_features").alias("f")).groupBy("f.feature", "f.sentiment").agg(F.count("*").alias("labels"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{k}' AS kind, (SELECT column_name FROM (SELECT *, row_number() OVER () AS i FROM (DESCRIBE {t})) WHERE {' OR '.join(f'contains(lower(column_name), {chr(39)}{w}{chr(39)})' for w in ws)} ORDER BY i LIMIT 1) AS column_name" for t in ("orders", "part", "documents", "pages") for k, ws in S.PREVIEW_COLUMNS.items()))
def detected_columns(spark, d):
    found = [(t, k, scans.detect_column(table(spark, d, t).columns, ws)) for t in ("orders", "part", "documents", "pages") for k, ws in S.PREVIEW_COLUMNS.items()]
    return spark.createDataFrame(found, "table_name string, kind string, column_name string")


_NAMED = "list_extract(['Smart Bottle ', 'Charger ', 'Nutri ', 'Bolt ', 'Care ', 'Mixer ', 'Lamp '], (p_partkey % 7 + 1)::INTEGER) || p_name"


def _category_sql(rules: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(name), '{'|'.join(ws)}') THEN '{label}'" for label, ws in S.CATEGORY_RULES[rules]) + " ELSE 'General' END"


@query(f"WITH n AS (SELECT {_NAMED} AS name FROM part) SELECT {', '.join(f'{_category_sql(r)} AS {r}' for r in S.CATEGORY_RULES)}, count(*) AS products FROM n GROUP BY 1, 2, 3")
def category_rules(spark, d):
    name = F.concat(scans.pick(["Smart Bottle ", "Charger ", "Nutri ", "Bolt ", "Care ", "Mixer ", "Lamp "], F.col("p_partkey")), "p_name")
    return table(spark, d, "part").select(name.alias("name")).groupBy(*[scans.category(F.col("name"), r).alias(r) for r in S.CATEGORY_RULES]).agg(F.count("*").alias("products"))


@query(f"WITH {_EV} SELECT 'P1' AS chosen, count(*) AS reviews FROM ev WHERE product_name = 'P1' UNION ALL SELECT 'All Products', count(*) FROM ev")
def product_filter(spark, d):
    rows = event_reviews(spark, d)
    one = lambda p: scans.for_product(rows, p).agg(F.count("*").alias("reviews")).select(F.lit(p).alias("chosen"), "reviews")
    return one("P1").union(one("All Products"))


@query(f"""WITH {_EV}, s AS (SELECT product_name, CASE review_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN 'last week' WHEN 3 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS t FROM ev),
p AS (SELECT product_name, coalesce(try_strptime(t, '%Y-%m-%dT%H:%M:%S'), try_strptime(t, '%Y-%m-%d %H:%M:%S'), try_strptime(t, '%Y-%m-%d')) AS t FROM s)
SELECT product_name, count(*) AS reviews, strftime(min(t), '%Y-%m-%d %H:%M:%S') AS first_time, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS last_time FROM p WHERE t IS NOT NULL GROUP BY 1""")
def parsed_times(spark, d):
    k, ts = F.col("review_id") % 5, F.col("ts").cast("timestamp")
    raw = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd")).when(k == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(k == 2, "last week").when(k == 4, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
    t = F.coalesce(*[F.try_to_timestamp(F.col("raw"), F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")])
    rows = event_reviews(spark, d).select("product_name", raw.alias("raw")).withColumn("t", t).filter("t IS NOT NULL")
    show = lambda c, n: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(n)
    return rows.groupBy("product_name").agg(F.count("*").alias("reviews"), show(F.min("t"), "first_time"), show(F.max("t"), "last_time"))


@query(f"WITH {_EV} SELECT review_id, product_name FROM ev ORDER BY md5(review_id::VARCHAR), review_id LIMIT 3")
def sample_rows(spark, d):
    return event_reviews(spark, d).orderBy(F.md5(F.col("review_id").cast("string").cast("binary")), "review_id").limit(3).select("review_id", "product_name")


@query(f"WITH {_RV} SELECT product_name, count(*) AS mentions FROM rv WHERE confidence < 0.95 AND sentiment = 'negative' GROUP BY 1")
def low_confidence(spark, d):
    return line_reviews(spark, d).filter((F.col("confidence") < 0.95) & (F.col("sentiment") == "negative")).groupBy("product_name").agg(F.count("*").alias("mentions"))


# records


@query(f"WITH {_EV} SELECT review_id, CASE WHEN doc_id IS NULL THEN rating ELSE quality END::INTEGER AS rating, toxic FROM ev LEFT JOIN labels ON doc_id = review_id")
def enriched_reviews(spark, d):
    right = table(spark, d, "labels").select(F.col("doc_id").alias("review_id"), F.col("quality").cast("int").alias("rating"), "toxic")
    return R.enriched(event_reviews(spark, d).select("review_id", "rating"), right, "review_id")


@query(f"WITH {_DOC} SELECT language, sum(length(review_text))::BIGINT AS chars, 'none' AS remark FROM doc GROUP BY 1")
def default_columns(spark, d):
    rows = document_reviews(spark, d)
    text = R.first_present(rows, ["clean_text", "review_text"], "")
    return rows.groupBy("language").agg(F.sum(F.length(text)).cast("long").alias("chars")).withColumn("remark", R.first_present(rows, ["remark"], "none"))


_RESULTS = "res AS (SELECT doc_id AS review_id, CASE WHEN toxic = 1 THEN 'negative' ELSE 'positive' END AS overall_sentiment FROM labels)"


def _results(spark, d):
    return table(spark, d, "labels").select(F.col("doc_id").alias("review_id"), F.when(F.col("toxic") == 1, "negative").otherwise("positive").alias("overall_sentiment"))


@query(f"WITH {_DOC}, {_RESULTS} SELECT review_id, coalesce(overall_sentiment, 'neutral') AS overall_sentiment, overall_sentiment IS NULL AS human_review_needed, CASE WHEN overall_sentiment IS NULL THEN '{S.MISSING_RESULT}' END AS error_message FROM doc LEFT JOIN res USING (review_id)")
def results_attached(spark, d):
    return R.with_results(document_reviews(spark, d).select("review_id"), _results(spark, d))


@query(f"WITH {_DOC}, {_RESULTS} SELECT product_name, overall_sentiment, count(*) AS reviews FROM doc JOIN res USING (review_id) GROUP BY 1, 2")
def keyed_results(spark, d):
    return document_reviews(spark, d).join(_results(spark, d), "review_id").groupBy("product_name", "overall_sentiment").agg(F.count("*").alias("reviews"))


@query(f"WITH {_EV}, {_RESULTS} SELECT coalesce(overall_sentiment, sentiment) AS sentiment, count(*) AS reviews FROM ev LEFT JOIN res USING (review_id) GROUP BY 1")
def sentiment_lookup(spark, d):
    rows = event_reviews(spark, d).join(_results(spark, d), "review_id", "left")
    return rows.select(F.coalesce("overall_sentiment", "sentiment").alias("sentiment")).groupBy("sentiment").agg(F.count("*").alias("reviews"))


@query(f"WITH a AS (SELECT doc_id AS old_id, 'k' || doc_id AS key FROM documents), b AS (SELECT doc_id + 1000000 AS new_id, 'k' || doc_id AS key FROM labels) SELECT old_id, new_id FROM a JOIN b USING (key)")
def id_mapping(spark, d):
    key = F.concat(F.lit("k"), F.col("doc_id")).alias("key")
    return R.id_map(table(spark, d, "documents").select(F.col("doc_id").alias("old_id"), key), table(spark, d, "labels").select((F.col("doc_id") + 1_000_000).alias("new_id"), key), "key")


@query(f"""WITH {_EV}, n AS (SELECT *, (row_number() OVER (PARTITION BY product_name ORDER BY ts, review_id) - 1) // 100 + 1 AS batch_no FROM ev), b AS (SELECT product_name, batch_no, avg(rating) AS a FROM n GROUP BY 1, 2),
w AS (SELECT product_name, batch_no FROM (SELECT *, row_number() OVER (PARTITION BY product_name ORDER BY round(a, 6), batch_no) AS r FROM b) WHERE r = 1) SELECT review_id, product_name, batch_no FROM n JOIN w USING (product_name, batch_no)""")
def batch_drilldown(spark, d):
    rows = positions(event_reviews(spark, d), ["product_name"], F.to_date("ts"), ["ts", "review_id"]).withColumn("batch_no", F.floor(F.col("idx") / 100) + 1)
    means = rows.groupBy("product_name", "batch_no").agg(F.round(F.avg("rating"), 6).alias("a"))
    worst = means.groupBy("product_name").agg(F.min(F.struct("a", "batch_no")).alias("w")).select("product_name", F.col("w.batch_no").alias("batch_no"))
    return rows.join(worst, ["product_name", "batch_no"], "left_semi").select("review_id", "product_name", "batch_no")


@query(f"SELECT * FROM (SELECT product_name, feature, priority, level FROM {of('escalation_rank')} ORDER BY priority DESC, product_name, feature LIMIT 10) WHERE product_name LIKE 'Brand#1%'")
def escalations_of_product(spark, d):
    top = C._issues(spark, d).select("product_name", "feature", r4("priority", 2).alias("priority"), "level").orderBy(F.desc("priority"), "product_name", "feature").limit(10)
    return top.filter(F.col("product_name").startswith("Brand#1"))


@query(f"WITH {_DOC}, c AS (SELECT md5('{{\"language\":\"' || language || '\",\"review_id\":' || review_id || '}}') AS key, review_id FROM doc WHERE language IS NOT NULL) SELECT count(*) AS cached, (SELECT count(*) FROM c WHERE review_id % 3 <> 0) AS open, min(key) AS first_key FROM c WHERE review_id % 3 = 0")
def response_cache(spark, d):
    rows = document_reviews(spark, d).filter("language IS NOT NULL").select("review_id", "language")
    cache = rows.filter("review_id % 3 = 0").select(sinks.cache_key(["review_id", "language"]).alias("key"), F.lit("{}").alias("response"))
    found, rest = sinks.cached(rows, cache, ["review_id", "language"])
    return found.agg(F.count("*").alias("cached"), F.min("key").alias("first_key")).crossJoin(rest.agg(F.count("*").alias("open")))


@query("SELECT user_id, event_id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def job_states(spark, d):
    return sinks.latest_states(table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("status")), "user_id", ["event_id"])


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN NULL ELSE turn END AS n, CASE WHEN turn % 3 = 2 THEN NULL ELSE role END AS who FROM conversations""")
def fenced_json(spark, d):
    body = F.to_json(F.struct(F.col("turn").alias("n"), F.col("role").alias("who")), {"ignoreNullFields": "false"})
    raw = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("turn") % 3 == 1, F.concat(F.lit(" ```"), body, F.lit("``` "))).otherwise("no answer")
    return table(spark, d, "conversations").select("conv_id", "turn", R.parsed_response(raw, "n long, who string").alias("x")).select("conv_id", "turn", F.col("x.n").alias("n"), F.col("x.who").alias("who"))


# sinks, written and read back


@query(f"WITH {O._RATES} SELECT product_name, feature AS feature_name, 'W' || window_no AS window_label, {_r('complaint_rate')}, {_r('praise_rate')}, {_r('z_score')} FROM zz")
def saved_trend_windows(spark, d):
    path = fresh_path(spark, "run")
    sinks.create_tables(spark, path)
    sinks.save_trend_windows(T.z_scores(C._rates(spark, d)), path, F.lit("2024-01-01").cast("timestamp"))
    return spark.read.parquet(f"{path}/trend_windows").select("product_name", "feature_name", "window_label", *[r4(c).alias(c) for c in ("complaint_rate", "praise_rate", "z_score")])


@query(f"WITH {_EV} SELECT 'reviews' AS table_name, count(*) AS saved FROM ev UNION ALL SELECT 'feature_extractions', count(*) FROM ev WHERE feature_no IS NOT NULL UNION ALL SELECT 'action_briefs', count(DISTINCT product_name) FROM ev UNION ALL SELECT 'escalations', 0 UNION ALL SELECT 'trend_windows', 0")
def saved_run(spark, d):
    store, rows = snapshots.Store(spark, fresh_path(spark, "run")), event_reviews(spark, d)
    features = rows.filter("feature_no IS NOT NULL").select("review_id", F.concat(F.lit("F"), "feature_no").alias("feature"), "sentiment")
    out = {"reviews": rows.withColumn("timestamp", F.col("ts")), "feature_extractions": features, "action_briefs": rows.select("product_name").distinct()}
    store.save({"reviews": rows}, "first")
    store.save(out, "second", clear=True)
    store.save(out, "second", clear=True)  # a repeated run adds nothing
    counts = [store.read(t).agg(F.count("*").alias("saved")).select(F.lit(t).alias("table_name"), "saved") for t in sinks.TABLES]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3]).union(counts[4])


# readers by byte ranges, and the stream of stages


@query("SELECT doc_id::VARCHAR AS review_id, coalesce(source, '') AS product_name, length(coalesce(text, ''))::BIGINT AS chars, md5(coalesce(text, '')) AS digest FROM documents")
def csv_ranges(spark, d):
    path = fresh_path(spark, "csv")
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("product_name"), F.col("text").alias("review_text"))
    rows.write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    text = F.coalesce("review_text", F.lit(""))
    return splittable.read_csv(spark, path).select(F.col("doc_id").alias("review_id"), F.coalesce("product_name", F.lit("")).alias("product_name"), F.char_length(text).cast("long").alias("chars"), F.md5(text).alias("digest"))


@query("SELECT conv_id, turn::BIGINT AS turn, role, md5(coalesce(text, '')) AS digest FROM conversations")
def json_ranges(spark, d):
    path = fresh_path(spark, "json")
    rows = table(spark, d, "conversations").select(F.to_json(F.struct("conv_id", "turn", "role", F.col("text").alias("review_text"))).alias("v"))
    rows.select(F.concat(F.lit("[ "), "v", F.lit(" ]")).alias("value")).write.text(path)
    return splittable.read_json(spark, path).select("conv_id", "turn", "role", F.md5(F.coalesce("review_text", F.lit(""))).alias("digest"))


@query(O.SQL["lifecycle_transitions"])
def stream_lifecycle(spark, d):
    return lifecycle.run_lifecycle(spark, C._rates(spark, d), base=20.0).select("product_name", "feature", "window_no", "from_stage", "stage")


# insights

_TYPE = lambda i: "CASE type " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in S.ANOMALY_TEXTS.items()) + f" ELSE '{S.ANOMALY_DEFAULT[i]}' END"


@query(f"SELECT product_name, week_no, type, {_TYPE(0)} AS action, {_TYPE(1)} AS meaning FROM {of('weekly_anomalies')}")
def anomaly_insights(spark, d):
    return I.anomaly_insights(W.weekly_anomalies(C._weeks(spark, d))).select("product_name", "week_no", "type", "action", "meaning")


@query(f"SELECT product_name, week_no, type, z, metric FROM {of('weekly_anomalies')} ORDER BY abs(z) DESC, product_name, week_no, type LIMIT 20")
def anomalies_by_z(spark, d):
    rows = W.weekly_anomalies(C._weeks(spark, d)).select("product_name", "week_no", "type", r4("z").alias("z"), r4("metric").alias("metric"))
    return rows.orderBy(F.abs("z").desc(), "product_name", "week_no", "type").limit(20)


_SPIKES = f"""h AS (SELECT *, dense_rank() OVER (PARTITION BY product_name ORDER BY week_end) AS week_no FROM {of('feature_heatmap')})
SELECT product_name, week_no, feature, z, 'Audit ' || feature || ' issues immediately.' AS action, upper(feature[1]) || lower(feature[2:]) || ' complaints are heavily spiking above normal baseline.' AS meaning FROM h"""


@query(f"WITH {_SPIKES} WHERE week_no > 3 AND z > 3.0")
def feature_spikes(spark, d):
    names, rows = C._features(spark, d)
    heat = W.feature_heatmap(rows, names).withColumn("z", r4("z"))
    return I.anomaly_insights(I.feature_spikes(heat), feature="feature").select("product_name", "week_no", "feature", "z", "action", "meaning")


@query(f"""WITH {_RV}, {O._weeks('rv')} SELECT product_name, {_r('max(avg_rating)', 4, 'peak_rating')}, {_r('max_by(avg_rating, week_no)', 4, 'last_rating')}, {_r('max_by(z_avg_rating, week_no)', 4, 'last_z')} FROM wk GROUP BY 1""")
def weekly_peak(spark, d):
    rows = W.weekly_z(C._weeks(spark, d))
    return rows.groupBy("product_name").agg(r4(F.max("avg_rating")).alias("peak_rating"), r4(F.max_by("avg_rating", "week_no")).alias("last_rating"), r4(F.max_by("z_avg_rating", "week_no")).alias("last_z"))


@query(f"WITH {_RV}, {O._weeks('rv')} SELECT product_name, count(*) AS weeks, CASE WHEN count(*) < 60 THEN '{S.TOO_FEW_WEEKS}' END AS error FROM wk GROUP BY 1")
def weekly_guard(spark, d):
    return R.with_guard(C._weeks(spark, d), least=60)


_ADVICE = f"""CASE level WHEN 'critical' THEN CASE WHEN severity >= 80 THEN '{S.RECOMMENDATIONS['critical'][0]}' WHEN velocity >= 70 THEN '{S.RECOMMENDATIONS['critical'][1]}' ELSE '{S.RECOMMENDATIONS['critical'][2]}' END
WHEN 'high' THEN CASE WHEN reach >= 70 THEN '{S.RECOMMENDATIONS['high'][0]}' WHEN velocity >= 50 THEN '{S.RECOMMENDATIONS['high'][1]}' ELSE '{S.RECOMMENDATIONS['high'][2]}' END
WHEN 'medium' THEN CASE WHEN velocity >= 40 THEN '{S.RECOMMENDATIONS['medium'][0]}' ELSE '{S.RECOMMENDATIONS['medium'][1]}' END ELSE '{S.RECOMMENDATIONS['low'][0]}' END"""
_LAST = "last AS (SELECT product_name, feature, max_by(stage, window_no) AS lifecycle_stage FROM stages GROUP BY 1, 2)"
_RECORDS = f"""WITH {O._STAGES}, {_LAST}, {O._ISSUES[len(_RV) + 2:]}, rec AS (SELECT lv.product_name, lv.feature, level, coalesce(lifecycle_stage, 'detected') AS lifecycle_stage,
CASE level WHEN 'critical' THEN 'immediate' WHEN 'high' THEN 'urgent' WHEN 'medium' THEN 'planned' ELSE 'track' END AS urgency, {_ADVICE} AS recommendation, level IN ('critical', 'high') AS requires_attention FROM lv LEFT JOIN last USING (product_name, feature))"""


def _records(spark, d):
    last = C._stages(spark, d).groupBy("product_name", "feature").agg(F.max_by("stage", "window_no").alias("lifecycle_stage"))
    return I.action_records(C._issues(spark, d).join(last, ["product_name", "feature"], "left"))


@query(f"{_RECORDS} SELECT * FROM rec")
def action_records(spark, d):
    return _records(spark, d).select("product_name", "feature", "level", "lifecycle_stage", "urgency", "recommendation", "requires_attention")


@query(f"{_RECORDS}, p AS (SELECT product_name, count_if(urgency = 'immediate')::INTEGER AS immediate_actions, list_sort(list(DISTINCT {O._TEAM('feature')})) AS t FROM rec GROUP BY 1) SELECT product_name, immediate_actions, 2::INTEGER AS avoid_count, array_to_string(t, ',') AS teams_addressed FROM p")
def brief_summaries(spark, d):
    rows = _records(spark, d).withColumn("team", E.primary_team(F.col("feature")))
    by = rows.groupBy("product_name").agg(F.collect_list(F.when(F.col("urgency") == "immediate", F.col("feature"))).alias("now"), F.collect_set("team").alias("teams"))
    briefs = by.select("product_name", F.create_map(F.lit("Immediate"), "now").alias("timeline"), X.literal_array(S.DO_NOT_DO).alias("do_not_do"), F.map_from_arrays("teams", F.transform("teams", lambda t: F.array(t))).alias("teams"))
    return I.brief_summary(briefs)


_CARD = S.CARD_TEXTS
_QUALITY = "CASE WHEN top IS NULL THEN '" + _CARD["quality_none"] + "' " + " ".join(f"WHEN top IN ({', '.join(repr(w) for w in ws)}) THEN '{t}'" for ws, t in _CARD["quality"]) + f" ELSE '{_CARD['quality_other']}' || top END"
_MARKETING = f"CASE WHEN top IS NULL THEN '{_CARD['marketing_none']}' WHEN contains(top, 'packaging') THEN '{_CARD['marketing_packaging']}' ELSE '{_CARD['marketing_other']}' END"
_TOPS = f"""{_EV}, k AS (SELECT product_name, list_extract(['packaging', 'battery', 'delivery', 'price', 'cap', 'quality'], feature_no + 1) AS feature, count_if(sentiment = 'negative') / count(*) * 100::DOUBLE AS rate FROM ev WHERE feature_no IS NOT NULL GROUP BY 1, 2),
kr AS (SELECT *, row_number() OVER (PARTITION BY product_name ORDER BY round(rate, 6) DESC, feature) AS r FROM k WHERE rate > 0)"""


def _tops(spark, d):
    rows = event_reviews(spark, d).filter("feature_no IS NOT NULL").withColumn("feature", scans.pick(["packaging", "battery", "delivery", "price", "cap", "quality"], F.col("feature_no")))
    rates = rows.groupBy("product_name", "feature").agg(F.round(percent(F.count_if(F.col("sentiment") == "negative"), F.count("*")), 6).alias("rate")).filter("rate > 0")
    return E.top_per(rates, ["product_name"], [F.desc("rate"), F.col("feature")], 3)


@query(f"WITH {_TOPS}, p AS (SELECT DISTINCT product_name FROM ev), t AS (SELECT p.product_name, feature AS top FROM p LEFT JOIN kr ON kr.product_name = p.product_name AND r = 1) SELECT product_name, {_QUALITY} AS quality, {_MARKETING} AS marketing FROM t")
def team_cards(spark, d):
    products = event_reviews(spark, d).select("product_name").distinct()
    top = products.join(_tops(spark, d).filter("rank = 1"), "product_name", "left")
    return top.select("product_name", I.team_cards(F.col("feature")).alias("c")).select("product_name", "c.quality", "c.marketing")


_RULE = "=" * 60
_NL = "chr(10)"


@query(f"""WITH {_TOPS}, n AS (SELECT product_name, count(*) AS reviews FROM ev GROUP BY 1), i AS (SELECT product_name, string_agg(r || '. ' || upper(feature) || ' — Complaint Rate: ' || printf('%.1f', rate) || '%', {_NL} ORDER BY r) AS issues FROM kr WHERE r <= 3 GROUP BY 1)
SELECT product_name, '{_RULE}' || {_NL} || 'ACTION BRIEF' || {_NL} || '{_RULE}' || {_NL} || 'Total Reviews: ' || reviews || {_NL} || 'Product: ' || product_name || {_NL} || {_NL} || 'TOP 3 ISSUES:' || {_NL} || coalesce(issues, 'No significant issues detected') || {_NL} || {_NL} || 'TEAM ACTIONS:' || {_NL} || 'Quality Team: check' || {_NL} || {_NL}
|| 'DO NOT DO:' || {_NL} || '- {S.DO_NOT_DO[0]}' || {_NL} || '- {S.DO_NOT_DO[1]}' || {_NL} || {_NL} || '{_RULE}' AS brief FROM n LEFT JOIN i USING (product_name)""")
def brief_texts(spark, d):
    counts = event_reviews(spark, d).groupBy("product_name").agg(F.count("*").alias("reviews"))
    issues = _tops(spark, d).groupBy("product_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature", "rate"))), lambda x: F.struct(x["feature"].alias("feature"), x["rate"].alias("rate"))).alias("issues"))
    rows = counts.join(issues, "product_name", "left").withColumns({"issues": F.coalesce("issues", F.array().cast("array<struct<feature:string,rate:double>>")), "actions": X.literal_array(["Quality Team: check"]), "do_not_do": X.literal_array(S.DO_NOT_DO)})
    return I.brief_text(rows)


_CUR = "CASE WHEN {0} > 0 THEN '+' ELSE '' END || CASE WHEN abs({0}) >= 10000000 THEN '₹' || printf('%.1f', abs({0}) / 10000000) || ' Cr' WHEN abs({0}) >= 100000 THEN '₹' || printf('%.1f', abs({0}) / 100000) || 'L' WHEN abs({0}) >= 1000 THEN '₹' || printf('%.0f', abs({0}) / 1000) || 'K' ELSE '₹' || printf('%.0f', abs({0})) END"


@query(f"SELECT product_name, scenario, {_CUR.format('(revenue_impact * 1000)')} AS impact FROM {of('revenue_scenarios')}")
def scenario_table(spark, d):
    return C.QUERIES["revenue_scenarios"](spark, d).select("product_name", "scenario", I.currency(F.col("revenue_impact") * 1000).alias("impact"))


@query(f"""WITH {_EV}, p AS (SELECT product_name, round(sum(rating) / count(rating), 4) AS rating, sum(value) AS revenue FROM ev GROUP BY 1), s AS (SELECT *, unnest([2.0, 8.0, 20.0, 40.0])::DOUBLE AS complaint_rate FROM p),
q AS (SELECT *, greatest(1.0, least(5.0, round(rating - (complaint_rate - 8.0) * 0.08, 1)))::DOUBLE AS predicted_rating FROM s), t AS (SELECT *, round(rating - predicted_rating, 4) AS drop_ FROM q)
SELECT product_name, complaint_rate, predicted_rating, {_r('drop_', 2, 'star_drop')}, CASE WHEN drop_ > 1.5 THEN 'CRITICAL' WHEN drop_ > 0.8 THEN 'HIGH' WHEN drop_ > 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM t""")
def slider_predictions(spark, d):
    rows = event_reviews(spark, d).groupBy("product_name").agg(F.round(F.sum("rating") / F.count("rating"), 4).alias("rating"), F.sum("value").alias("revenue"))
    return I.slider_prediction(rows, "rating", [2, 8, 20, 40], F.col("revenue")).select("product_name", "complaint_rate", "predicted_rating", r4("star_drop", 2).alias("star_drop"), "risk_level")


@query(f"""WITH {_EV}, w AS (SELECT review_id, CASE WHEN user_id % 2 = 0 THEN 'F' || feature_no ELSE 'G' END AS feature, CASE WHEN user_id % 2 = 0 THEN 'high' ELSE 'medium' END AS intensity, CASE WHEN user_id % 2 = 0 THEN 0.9 ELSE 0.6 END::DOUBLE AS urgency FROM ev WHERE sentiment IN ('negative', 'mixed'))
SELECT * FROM w ORDER BY urgency DESC, review_id LIMIT 20""")
def reply_worst_feature(spark, d):
    f = lambda name, s, i: F.struct(name.alias("feature"), F.lit(s).alias("sentiment"), F.lit(i).cast("string").alias("intensity"))
    own = F.concat(F.lit("F"), F.col("feature_no"))
    features = F.when(F.col("user_id") % 2 == 0, F.array(f(F.lit("G"), "negative", "odd"), f(own, "negative", "HIGH".lower()), f(F.lit("H"), "positive", "high"), f(F.lit("I"), "negative", "high"))).otherwise(F.array(f(F.lit("L"), "negative", "low"), f(F.lit("G"), "negative", "medium")))
    rows = event_reviews(spark, d).filter(F.col("sentiment").isin("negative", "mixed")).select("review_id", I.worst_feature(features).alias("w")).select("review_id", "w.*")
    return rows.orderBy(F.desc("urgency"), "review_id").limit(20)


# trends and lifecycle


@query(f"WITH {O._RATES} SELECT product_name, feature, {_r('max_severity')}, direction FROM dir ORDER BY round(max_severity, 4) DESC, product_name, feature LIMIT 20")
def trends_by_severity(spark, d):
    return C._directions(spark, d).select("product_name", "feature", r4("max_severity").alias("max_severity"), "direction").orderBy(F.desc("max_severity"), "product_name", "feature").limit(20)


@query(f"WITH {O._RATES}, e AS (SELECT product_name, feature FROM dir WHERE any_emerging) SELECT product_name, feature, ('W' || min_by(window_no, [-round(complaint_rate, 6), window_no])) AS worst_window, {_r('max(complaint_rate)', 4, 'worst_rate')} FROM rates JOIN e USING (product_name, feature) GROUP BY 1, 2")
def trend_worst_window(spark, d):
    rates = C._rates(spark, d)
    hot = T.directions(rates).filter("any_emerging").select("product_name", "feature")
    worst = F.min(F.struct((-F.round("complaint_rate", 6)).alias("m"), "window_no"))["window_no"]
    return rates.join(hot, ["product_name", "feature"], "left_semi").groupBy("product_name", "feature").agg(F.concat(F.lit("W"), worst).alias("worst_window"), r4(F.max("complaint_rate")).alias("worst_rate"))


@query(f"WITH {O._RATES} SELECT product_name, feature, window_no, {_r('complaint_rate')} FROM (SELECT *, row_number() OVER (PARTITION BY product_name, feature ORDER BY window_no) AS r FROM rates) WHERE r <= 5")
def first_windows(spark, d):
    return E.top_per(C._rates(spark, d), ["product_name", "feature"], [F.col("window_no")], 5).select("product_name", "feature", "window_no", r4("complaint_rate").alias("complaint_rate"))


_RUNS = f"""WITH {O._STAGES}, g AS (SELECT *, num - sum(hi::INT) OVER (PARTITION BY product_name, feature ORDER BY window_no) AS grp FROM s1), r AS (SELECT product_name, feature, grp, count(*) AS n FROM g WHERE hi GROUP BY 1, 2, 3)
SELECT s.product_name, s.feature, coalesce(max(n), 0)::BIGINT AS longest_run, coalesce(sum(n), 0)::BIGINT AS windows_above FROM (SELECT DISTINCT product_name, feature FROM rates) s LEFT JOIN r ON r.product_name = s.product_name AND r.feature = s.feature GROUP BY 1, 2"""


@query(_RUNS)
def lifecycle_runs(spark, d):
    return T.runs_above(C._rates(spark, d), 40.0).select("product_name", "feature", "longest_run", "windows_above")


_ISSUE_STATE = f"WITH {O._STAGES}, a AS (SELECT product_name, feature, max_by(stage, window_no) AS stage, max_by(severity, window_no) AS severity FROM stages GROUP BY 1, 2)"


def _issue_state(spark, d):
    last = C._stages(spark, d).groupBy("product_name", "feature").agg(F.max_by(F.struct("stage", "severity"), "window_no").alias("x"))
    return last.select("product_name", "feature", "x.*")


@query(f"{_ISSUE_STATE} SELECT product_name, feature, stage, stage <> 'resolved' AS active, stage IN ('systemic', 'persistent') AS requires_attention FROM a")
def issue_states(spark, d):
    return T.with_attention(_issue_state(spark, d)).select("product_name", "feature", "stage", "active", "requires_attention")


@query(f"{_ISSUE_STATE} SELECT product_name, feature, stage, severity FROM a WHERE stage IN ('systemic', 'persistent') ORDER BY severity DESC, product_name, feature LIMIT 5")
def critical_issues(spark, d):
    return T.with_attention(_issue_state(spark, d)).filter("requires_attention").select("product_name", "feature", "stage", "severity").orderBy(F.desc("severity"), "product_name", "feature").limit(5)


@query(f"{_ISSUE_STATE} SELECT product_name, count(*) AS issues, count_if(stage <> 'resolved')::BIGINT AS active, count_if(stage = 'resolved')::BIGINT AS resolved, count_if(stage IN ('systemic', 'persistent'))::BIGINT AS critical FROM a GROUP BY 1")
def lifecycle_managers(spark, d):
    rows = T.with_attention(_issue_state(spark, d))
    return rows.groupBy("product_name").agg(F.count("*").alias("issues"), F.count_if("active").alias("active"), F.count_if(~F.col("active")).alias("resolved"), F.count_if("requires_attention").alias("critical"))


@query(f"WITH {_EV} SELECT product_name, {_r('count_if(sentiment = ' + chr(39) + 'negative' + chr(39) + ') / count(*) * 100', 4, 'complaint_rate')} FROM (SELECT *, row_number() OVER (PARTITION BY product_name ORDER BY ts DESC, review_id DESC) AS r FROM ev) WHERE r <= 30 GROUP BY 1")
def tail_window(spark, d):
    last = R.tail_rows(event_reviews(spark, d), ["product_name"], [F.desc("ts"), F.desc("review_id")], 30)
    return last.groupBy("product_name").agg(r4(percent(F.count_if(F.col("sentiment") == "negative"), F.count("*"))).alias("complaint_rate"))


@query(f"WITH {O._RATES}, m AS (SELECT product_name, window_no, sum(negative_mentions) / sum(total_mentions) * 100::DOUBLE AS rate FROM rates GROUP BY 1, 2) SELECT product_name, {_r('avg(rate)', 4, 'mean_rate')}, {_r('max(rate)', 4, 'max_rate')}, min_by(window_no, [-round(rate, 6), window_no]) AS worst_window FROM m GROUP BY 1")
def window_extremes(spark, d):
    m = C._rates(spark, d).groupBy("product_name", "window_no").agg(percent(F.sum("negative_mentions"), F.sum("total_mentions")).alias("rate"))
    return m.groupBy("product_name").agg(r4(F.avg("rate")).alias("mean_rate"), r4(F.max("rate")).alias("max_rate"), F.min(F.struct((-F.round("rate", 6)).alias("m"), "window_no"))["window_no"].alias("worst_window"))


_ISSUE_WORDS = S.ISSUE_KEYWORDS
_ASPECT = "list_extract(['Packaging', 'the battery', 'a delivery', 'nothing', 'price and cap'], (review_id % 5 + 1)::INTEGER)"


@query(f"WITH {_DOC}, t AS (SELECT product_name, lower({_ASPECT} || ' ' || coalesce(review_text, '')) AS t FROM doc), k AS (SELECT product_name, unnest(list_filter({_LIST(_ISSUE_WORDS)}, lambda w: contains(t, w))) AS w FROM t) SELECT product_name, array_to_string(list_sort(list(DISTINCT w)), ',') AS features FROM k GROUP BY 1")
def detected_features(spark, d):
    aspect = scans.pick(["Packaging", "the battery", "a delivery", "nothing", "price and cap"], F.col("review_id"))
    text = F.lower(F.concat_ws(" ", aspect, "review_text"))
    rows = document_reviews(spark, d).select("product_name", F.explode(X.let(text, lambda t: F.filter(X.literal_array(_ISSUE_WORDS), lambda w: F.contains(t, w)))).alias("w"))
    return rows.groupBy("product_name").agg(F.array_join(F.array_sort(F.collect_set("w")), ",").alias("features"))


@query(f"""WITH {_DOC}, w AS (SELECT review_id // 100 AS window_no, regexp_extract_all(lower(review_text), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM doc), ph AS (SELECT window_no, ws[i] || ' ' || ws[i + 1] AS phrase FROM (SELECT *, unnest(generate_series(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 1))
SELECT window_no, count_if(phrase = 'of the')::BIGINT AS mentions FROM ph GROUP BY 1""")
def phrase_trend(spark, d):
    ws = X.words(F.col("review_text"))
    pairs = F.zip_with(F.expr("slice(ws, 1, size(ws) - 1)"), F.expr("slice(ws, 2, size(ws) - 1)"), lambda a, b: F.concat_ws(" ", a, b))
    rows = document_reviews(spark, d).select(F.floor(F.col("review_id") / 100).alias("window_no"), ws.alias("ws")).filter("size(ws) > 1")
    found = rows.select("window_no", F.size(F.filter(pairs, lambda p: p == "of the")).alias("n"))
    return found.groupBy("window_no").agg(F.sum("n").cast("long").alias("mentions"))


@query(f"""WITH {O._phrases()}, i AS (SELECT review_id, coalesce(language, 'und') AS product_name, row_number() OVER (PARTITION BY coalesce(language, 'und') ORDER BY review_id) - 1 AS idx, count(*) OVER (PARTITION BY coalesce(language, 'und')) AS n FROM doc),
wn AS (SELECT review_id, product_name, k + 1 AS window_no FROM (SELECT *, unnest(generate_series(0, idx // 25)) AS k FROM i WHERE n >= 50) WHERE k * 25 + 50 > idx AND k <= ceil((n - 50) / 25) AND least(50, n - k * 25) >= 25),
c AS (SELECT product_name, window_no::INTEGER AS window_no, phrase, count(*) AS mentions FROM p2 JOIN wn USING (review_id) GROUP BY ALL),
t AS (SELECT *, coalesce(max(mentions) FILTER (window_no = 1) OVER (PARTITION BY product_name, phrase), 0) AS baseline, coalesce(max(mentions) OVER (PARTITION BY product_name, phrase ORDER BY window_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, min(window_no) OVER (PARTITION BY product_name, phrase) AS first_seen FROM c)
SELECT *, mentions - baseline AS emergence_score FROM t WHERE mentions >= 5 AND baseline < 2""")
def phrase_tracker(spark, d):
    rows = document_reviews(spark, d).withColumns({"product_name": F.coalesce("language", F.lit("und")), "ts": F.timestamp_seconds(F.col("review_id") * 3600)})
    return vocabulary.emerging_tracked(rows, ["review_id"]).drop("emerging")


# numbers of a page


@query(f"WITH {_EV} SELECT count(*) AS reviews, count_if(rating = 1 AND value > 100)::BIGINT AS suspicious, CASE WHEN avg(rating) < 3.0 THEN 'ALERT' WHEN avg(rating) < 3.5 THEN 'WARNING' WHEN count_if(sentiment = 'negative') / count(*) * 100 > 40 THEN 'WARNING' ELSE 'OK' END AS alert FROM ev")
def kpi_alert(spark, d):
    bad = percent(F.count_if(F.col("sentiment") == "negative"), F.count("*"))
    alert = F.when(F.avg("rating") < 3.0, "ALERT").when((F.avg("rating") < 3.5) | (bad > 40), "WARNING").otherwise("OK")
    return event_reviews(spark, d).agg(F.count("*").alias("reviews"), F.count_if(F.expr("rating = 1 AND value > 100")).alias("suspicious"), alert.alias("alert"))


@query(f"WITH {_EV}, c AS (SELECT feature_no, count(*) AS n FROM ev GROUP BY 1), t AS (SELECT 'f' || coalesce(feature_no, 9) AS test_name, n >= 10 AS passed, n FROM c) SELECT test_name, '| ' || test_name || ' | ' || CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END || ' | ' || n || ' | 10 |' AS line FROM t")
def evaluation_report(spark, d):
    return V.report(_tests(spark, d)).select("test_name", "line")


def _tests(spark, d):
    c = event_reviews(spark, d).groupBy("feature_no").agg(F.count("*").alias("actual"))
    return c.select(F.concat(F.lit("f"), F.coalesce("feature_no", F.lit(9))).alias("test_name"), (F.col("actual") >= 10).alias("passed"), "actual", F.lit(10).alias("target"))


@query(f"WITH {_EV}, c AS (SELECT feature_no, count(*) AS n FROM ev GROUP BY 1) SELECT count(*) AS total, count_if(n >= 10)::BIGINT AS passed, count_if(n < 10)::BIGINT AS failed, count_if(n >= 10) / count(*) * 100::DOUBLE AS pass_rate FROM c")
def pass_rates(spark, d):
    return V.pass_rates(_tests(spark, d))


_SETS = f"""WITH {_EV}, s AS (SELECT review_id, CASE WHEN user_id % 11 = 0 THEN []::VARCHAR[] ELSE list_distinct(['f' || feature_no, 'f' || (user_id % 3)]) END AS m, CASE WHEN review_id % 7 = 0 THEN []::VARCHAR[] ELSE list_distinct(['f' || (review_id % 6), 'f' || (user_id % 3)]) END AS x FROM ev),
k AS (SELECT review_id, list_filter(m, lambda f: list_contains(x, f)) AS a, list_filter(m, lambda f: NOT list_contains(x, f)) AS b, list_filter(x, lambda f: NOT list_contains(m, f)) AS c FROM s)"""


def _matches(spark, d):
    f = lambda c: F.struct(F.concat(F.lit("F"), c).alias("feature"))
    found = event_reviews(spark, d).filter("review_id % 7 <> 0").select("review_id", F.array(f(F.col("review_id") % 6), f(F.col("user_id") % 3)).alias("extracted_features"))
    return V.feature_matches(_labelled(spark, d), found)


@query(f"{_SETS} SELECT review_id, array_to_string(list_sort(a), ',') AS matches, array_to_string(list_sort(b), ',') AS missed, array_to_string(list_sort(c), ',') AS extra FROM k")
def feature_sets(spark, d):
    return _matches(spark, d).select("review_id", *[F.array_join(F.array_sort(c), ",").alias(c) for c in ("matches", "missed", "extra")])


@query(f"""{_SETS}, t AS (SELECT sum(len(a))::BIGINT AS tp, sum(len(c))::BIGINT AS fp, sum(len(b))::BIGINT AS fn FROM k) SELECT tp AS true_positives, fp AS false_positives, fn AS false_negatives, round(tp / (tp + fp) * 100, 1)::DOUBLE AS precision, round(tp / (tp + fn) * 100, 1)::DOUBLE AS recall, round(2 * tp / (2 * tp + fp + fn) * 100, 1)::DOUBLE AS f1_score FROM t""")
def feature_precision_recall(spark, d):
    return V.precision_recall(_matches(spark, d))


# text steps

_TAGGED = "text || list_extract([' so GOOD 👍 and 🔥', ' 🚀 WORST-EVER box 👍👍', ' PLAIN words i bought', ' ok'], (turn % 4 + 1)::INTEGER)"
_EMOJI_SQL = "replace(replace(replace({0}, '👍', ' [POSITIVE] '), '🔥', ' [EXCELLENT] '), '🚀', ' [ROCKET] ')"
_SPACED = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


def _tagged(spark, d):
    extra = scans.pick([" so GOOD 👍 and 🔥", " 🚀 WORST-EVER box 👍👍", " PLAIN words i bought", " ok"], F.col("turn"))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.concat("text", extra).alias("text"))


_TAGS = f"tg AS (SELECT conv_id, turn, role, {_SPACED.format(_EMOJI_SQL.format(_TAGGED))} AS t FROM conversations)"


@query(f"WITH {_TAGS} SELECT conv_id, turn, role, md5(t) AS text_md5, array_to_string(list_distinct(regexp_extract_all(t, '\\[[\\p{{Lu}}\\p{{N}}][\\p{{Lu}}\\p{{N}} \\-]*\\]')), ',') AS tags FROM tg".replace("list_distinct(", "dd("))
def emoji_tags(spark, d):
    return _tagged(spark, d).withColumn("e", X.emoji_tags(F.col("text"))).select("conv_id", "turn", "role", F.md5("e.text").alias("text_md5"), F.array_join(F.array_sort("e.tags"), ",").alias("tags"))


SQL["emoji_tags"] = SQL["emoji_tags"].replace("dd(", "list_sort(list_distinct(").replace("), ',') AS tags", ")), ',') AS tags")
_UP = "regexp_matches(w, '\\p{L}.*\\p{L}') AND NOT regexp_matches(w, '[\\p{Ll}\\p{Lt}\\p{Lm}\\p{Lo}]')"
_TITLE = "array_to_string(list_transform(regexp_extract_all(w, '\\p{L}+|[^\\p{L}]+'), lambda x: upper(x[1]) || lower(x[2:])), '')"
_CALM = f"cm AS (SELECT *, string_split(t, ' ') AS ws FROM tg), cn AS (SELECT *, array_to_string(list_transform(ws, lambda w: CASE WHEN {_UP} THEN {_TITLE} ELSE w END), ' ') AS c, len(list_filter(ws, lambda w: {_UP})) > 0 AS caps FROM cm)"
_SQUEEZE = "regexp_replace(regexp_replace(regexp_replace({0}, '!!+', '!', 'g'), '\\?\\?+', '?', 'g'), '\\.\\.+', '.', 'g')"


@query(f"WITH {_TAGS}, {_CALM} SELECT conv_id, turn, role, caps, md5(c) AS calm_md5 FROM cn")
def caps_normalize(spark, d):
    e = X.emoji_tags(F.col("text"))["text"]
    words = F.split("t", " ")
    calm = F.array_join(F.transform(words, lambda w: F.when(X.is_shouted(w), X.title_case(w)).otherwise(w)), " ")
    return _tagged(spark, d).withColumn("t", e).select("conv_id", "turn", "role", F.exists(words, X.is_shouted).alias("caps"), F.md5(calm).alias("calm_md5"))


_FLAG = f"""fl AS (SELECT *, len(list_filter(string_split(t, ' '), lambda w: w <> '' AND NOT starts_with(w, '['))) AS n, len(regexp_extract_all(t, '\\[[\\p{{Lu}}\\p{{N}}][\\p{{Lu}}\\p{{N}} \\-]*\\]')) AS tags, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM tg),
fs AS (SELECT *, CASE WHEN n = 0 AND tags > 0 THEN 15 WHEN n < 5 THEN 10 ELSE least(100, ceil(CASE WHEN n >= 20 THEN 80 ELSE 50 + n * 1.5 END + CASE WHEN list_has_any(ws, {_LIST(S.PRODUCT_TERMS)}) THEN 10 ELSE 0 END + CASE WHEN list_has_any(ws, {_LIST(S.PERSONAL_TERMS)}) THEN 10 ELSE 0 END)) END::INTEGER AS score,
CASE WHEN n = 0 AND tags > 0 THEN 'only_emojis' WHEN n < 5 THEN 'too_short' ELSE array_to_string(list_filter([CASE WHEN NOT list_has_any(ws, {_LIST(S.PRODUCT_TERMS)}) THEN 'no_product_terms' END, CASE WHEN NOT list_has_any(ws, {_LIST(S.PERSONAL_TERMS)}) THEN 'no_personal_experience' END], lambda x: x IS NOT NULL), ',') END AS flags FROM fl)"""


@query(f"WITH {_TAGS}, {_FLAG} SELECT conv_id, turn, role, score, flags FROM fs")
def quality_flags(spark, d):
    rows = _tagged(spark, d).withColumn("e", X.emoji_tags(F.col("text")))
    t, tags = F.col("e.text"), F.col("e.tags")
    return rows.select("conv_id", "turn", "role", X.word_score(t, tags).alias("score"), F.array_join(X.quality_flags(t, tags), ",").alias("flags"))


@query(f"WITH {_TAGS}, {_FLAG} SELECT count(*) AS reviews, count_if(score >= 20)::BIGINT AS kept, count_if(score < 20)::BIGINT AS low_quality, {_r('avg(score)', 4, 'mean_score')} FROM fs")
def low_quality_filter(spark, d):
    rows = _tagged(spark, d).withColumn("e", X.emoji_tags(F.col("text"))).select(X.word_score(F.col("e.text"), F.col("e.tags")).alias("score"))
    return rows.agg(F.count("*").alias("reviews"), F.count_if(F.col("score") >= 20).alias("kept"), F.count_if(F.col("score") < 20).alias("low_quality"), r4(F.avg("score")).alias("mean_score"))


@query(f"""WITH b AS (SELECT * FROM (VALUES (1, NULL), (2, '  '), (3, 'SO GOOD!!! I bought this <b>product</b> for my home 👍'), (4, '🔥'), (5, 'bahut accha hai yaar mast')) v(n, t)) SELECT n, CASE n WHEN 3 THEN 'So Good! I bought this product for my home [Positive]' WHEN 4 THEN '[Excellent]' WHEN 5 THEN 'bahut accha hai yaar mast' ELSE '' END AS clean_text,
CASE n WHEN 4 THEN 'OTHER' WHEN 5 THEN 'HINGLISH' ELSE 'EN' END AS language, CASE n WHEN 3 THEN '[POSITIVE]' WHEN 4 THEN '[EXCELLENT]' ELSE '' END AS tags, CASE n WHEN 3 THEN 84 WHEN 4 THEN 15 WHEN 5 THEN 58 ELSE 0 END AS quality_score, n IN (1, 2, 4) AS low_quality FROM b""")
def preprocess_fixture(spark, d):
    rows = spark.createDataFrame([(1, None), (2, "  "), (3, "SO GOOD!!! I bought this <b>product</b> for my home 👍"), (4, "🔥"), (5, "bahut accha hai yaar mast")], "n int, review_text string")
    return X.preprocess(rows).select("n", "clean_text", "language", F.array_join("emoji_tags", ",").alias("tags"), "quality_score", "low_quality")


@query(None)
def preprocess_documents(spark, d):
    return X.preprocess(document_reviews(spark, d)).select("review_id", "clean_text", "language", "emoji_tags", "caps_intensity", "quality_score", "low_quality", "flags", "trust_score")


_WORDS = [e[5][0] for e in S.EMOTIONS] + ["nothing at all"]
_SAID = f"list_extract({_LIST(_WORDS)}, (turn % {len(_WORDS)} + 1)::INTEGER)"
_LOUD = lambda e: [t for t in e[5] if t in X.shouted(e[5])]
_CALM_TERMS = lambda e: [t.lower() for t in e[5] if t not in X.shouted(e[5])]
_REAL = f"""r0 AS (SELECT conv_id, turn, role, {_SAID} AS t FROM conversations), r1 AS (SELECT *, {', '.join(f"len(list_filter({_LIST(_LOUD(e)) if _LOUD(e) else '[]::VARCHAR[]'}, lambda k: contains(t, k))) + len(list_filter({_LIST(_CALM_TERMS(e)) if _CALM_TERMS(e) else '[]::VARCHAR[]'}, lambda k: contains(lower(t), k))) AS c_{e[0]}" for e in S.EMOTIONS)},
length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) / length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) > 0.6 AS loud FROM r0),
r2 AS (SELECT *, {', '.join(f"c_{e[0]} * {e[1]}{' + CASE WHEN loud THEN 30 ELSE 0 END' if e[0] == 'furious' else ''} AS s_{e[0]}" for e in S.EMOTIONS)} FROM r1), r3 AS (SELECT *, {' + '.join(f's_{e[0]}' for e in S.EMOTIONS)} AS total, greatest({', '.join(f's_{e[0]}' for e in S.EMOTIONS)}) AS top FROM r2),
r4 AS (SELECT conv_id, turn, role, CASE WHEN total = 0 THEN 'disappointed' {' '.join(f"WHEN s_{e[0]} = top THEN '{e[0]}'" for e in S.EMOTIONS)} END AS emotion, CASE WHEN total = 0 THEN 0.3 ELSE round(CASE WHEN c_furious >= 2 OR loud OR c_delighted >= 3 THEN greatest(least(0.95, top / total), 0.85) ELSE least(0.95, top / total) END, 2) END::DOUBLE AS confidence FROM r3)"""


@query(f"WITH {_REAL} SELECT conv_id, turn, role, emotion, confidence, confidence BETWEEN 0.4 AND 0.65 AS second_layer FROM r4")
def emotion_signals(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", scans.pick(_WORDS, F.col("turn")).alias("t"))
    return rows.select("conv_id", "turn", "role", X.emotion(F.col("t"), F.lit("negative")).alias("e")).select("conv_id", "turn", "role", "e.emotion", "e.confidence", X.needs_second_layer(F.col("e.confidence")).alias("second_layer"))


@query(f"WITH {_DOC}, {O._EMOTION} SELECT urgency, review_id FROM em")
def emotion_urgency_ids(spark, d):
    """The reviews of each urgency as rows: a list of all of them would be one value, however many there are."""
    return C._emotions(spark, d).select("urgency", "review_id")


@query(f"WITH {_DOC}, {O._EMOTION}, n AS (SELECT review_id, (row_number() OVER (ORDER BY review_id) - 1) // 50 + 1 AS window_no FROM doc) SELECT window_no, {', '.join(f'count_if(emotion = {chr(39)}{e[0]}{chr(39)})::BIGINT AS {e[0]}' for e in S.EMOTIONS)} FROM em JOIN n USING (review_id) GROUP BY 1")
def emotion_count_windows(spark, d):
    rows = positions(C._emotions(spark, d).withColumn("g", F.lit(1)), ["g"], F.floor(F.col("review_id") / 1000), ["review_id"])
    return rows.groupBy((F.floor(F.col("idx") / 50) + 1).alias("window_no")).agg(*[F.count_if(F.col("emotion") == e[0]).alias(e[0]) for e in S.EMOTIONS])


@query(f"WITH {_DOC}, {O._EMOTION}, {_EV} SELECT emotion, strftime(min(ts), '%Y-%m-%d') AS first_day, count(*) AS reviews FROM em LEFT JOIN ev USING (review_id) GROUP BY 1")
def emotion_days(spark, d):
    rows = C._emotions(spark, d).join(event_reviews(spark, d).select("review_id", "ts"), "review_id", "left")
    return rows.groupBy("emotion").agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"), F.count("*").alias("reviews"))


@query(f"""WITH s AS (SELECT review_id, flags, confidence AS c, CASE review_id % 4 WHEN 0 THEN 'mixed' WHEN 1 THEN 'negative' ELSE 'positive' END AS sentiment, CASE WHEN review_id % 5 = 0 THEN 0.5 ELSE 0.9 END AS sure FROM {of('sarcasm_pass1')}),
k AS (SELECT *, coalesce(flags <> '', FALSE) AS flagged, coalesce(flags <> '', FALSE) OR sure < 0.6 OR sentiment = 'mixed' AS needs_check FROM s), z AS (SELECT *, needs_check AND coalesce(c > 0.5, FALSE) AS sarcastic FROM k)
SELECT review_id, flagged, needs_check, sarcastic, needs_check OR sarcastic AS human_review, CASE WHEN sarcastic THEN 'ambiguous' ELSE sentiment END AS sentiment FROM z""")
def sarcasm_decisions(spark, d):
    k = F.col("review_id")
    mood, sure = F.when(k % 4 == 0, "mixed").when(k % 4 == 1, "negative").otherwise("positive"), F.when(k % 5 == 0, 0.5).otherwise(0.9)
    return document_reviews(spark, d).select("review_id", X.sarcasm_decision(F.col("review_text"), sure, mood).alias("s")).select("review_id", "s.*")


@query(f"WITH {_EV} SELECT review_id::VARCHAR AS review_key, rating FROM ev WHERE rating = 5 ORDER BY review_key")
def sorted_results(spark, d):
    return event_reviews(spark, d).filter("rating = 5").select(F.col("review_id").cast("string").alias("review_key"), "rating").orderBy("review_key")


# bots


def _bot_rows(spark, d):
    return document_reviews(spark, d).withColumns({"rating": F.col("review_id") % 5 + 1, "username": F.when(F.col("review_id") % 3 == 0, F.concat(F.lit("user_"), F.col("review_id")))})


_NEIGH = f"""{O._tfidf(O._UNIGRAMS, '> 0.5', O._TOP_TERMS)}, side AS (SELECT a, similarity FROM edge UNION ALL SELECT b, similarity FROM edge),
ng AS (SELECT a AS review_id, CASE WHEN max(similarity) > 0.7 THEN 'HIGH_SIMILARITY_MATCH' WHEN count(*) >= 3 THEN 'NETWORK_SIMILARITY' END AS signal FROM side GROUP BY 1)"""


@query(f"WITH {_NEIGH} SELECT review_id, signal FROM ng WHERE signal IS NOT NULL")
def neighbour_signals(spark, d):
    return B.neighbour_signals(document_reviews(spark, d), STOP_TEST)


_FIRSTS = O._tfidf(O._UNIGRAMS, "> 0.85", O._TOP_TERMS).replace(_DOC, f"{_DOC.replace('doc AS', 'doc0 AS', 1)}, key0 AS (SELECT *, min(review_id) OVER (PARTITION BY md5(replace(lower(coalesce(review_text, '')), ' ', ''))) AS first_id FROM doc0), doc AS (SELECT * FROM key0 WHERE review_id = first_id)")


@query(f"""WITH RECURSIVE {_FIRSTS},{O._COMPONENTS}, kind AS (SELECT key0.review_id, CASE WHEN key0.review_id <> first_id THEN 'EXACT' WHEN group_id <> key0.review_id THEN 'NEAR' ELSE '' END AS kind FROM key0 LEFT JOIN grp ON grp.review_id = key0.review_id),
sc AS (SELECT kind, CASE WHEN kind = '' THEN least(100, bot_score + CASE WHEN signal IS NULL THEN 0 ELSE 20 END) END AS score FROM kind JOIN {of('bot_scores')} o USING (review_id) LEFT JOIN {of('neighbour_signals')} g USING (review_id)),
t AS (SELECT count(*) AS scanned, count_if(kind = 'EXACT')::BIGINT AS exact, count_if(kind = 'NEAR')::BIGINT AS near, count_if(score > 75)::BIGINT AS confirmed, count_if(score > 25 AND score <= 75)::BIGINT AS suspicious FROM sc) SELECT *, scanned - exact - near - confirmed AS clean FROM t""")
def bot_totals(spark, d):
    return B.totals(B.bot_detection(_bot_rows(spark, d), STOP_TEST))


@query(f"SELECT kind, campaign_id, members, confidence FROM {of('text_campaigns')} WHERE confidence > 50 UNION ALL SELECT kind, campaign_id, members, confidence FROM {of('username_campaigns')} WHERE confidence > 50")
def confident_campaigns(spark, d):
    both = C.QUERIES["text_campaigns"](spark, d).unionByName(C.QUERIES["username_campaigns"](spark, d))
    return both.filter("confidence > 50").select("kind", "campaign_id", "members", "confidence")


_JUDGED = "SELECT value, (5 - least(4, floor(value / 25)))::INTEGER AS rating, CASE event_type WHEN 'error' THEN 'negative' WHEN 'purchase' THEN 'positive' ELSE 'neutral' END AS sentiment FROM events"


@query(f"""WITH j AS (SELECT * FROM ({_JUDGED}) WHERE value IS NOT NULL AND rating IS NOT NULL),
r AS (SELECT rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS rx, rank() OVER (ORDER BY rating) + (count(*) OVER (PARTITION BY rating) - 1) / 2.0 AS ry FROM j)
SELECT count(*) AS n, round(corr(rx, ry), 4) AS spearman FROM r""")
def rank_agreement(spark, d):
    return agreement.spearman(event_reviews(spark, d), "value", "rating").select("n", r4("spearman").alias("spearman"))


@query(f"""WITH j AS (SELECT sentiment AS a, CASE WHEN rating <= 2 THEN 'negative' WHEN rating = 3 THEN 'neutral' ELSE 'positive' END AS b FROM ({_JUDGED}) WHERE rating IS NOT NULL),
l AS (SELECT label, (SELECT count(*) FROM j WHERE a = label) AS x, (SELECT count(*) FROM j WHERE b = label) AS y FROM (SELECT a AS label FROM j UNION SELECT b FROM j)),
s AS (SELECT count(*) AS n, count_if(a = b) / count(*) AS observed, (SELECT sum(x::DOUBLE * y) FROM l) / (count(*)::DOUBLE * count(*)) AS expected FROM j)
SELECT n, round(observed, 4) AS observed, round(expected, 4) AS expected, round((observed - expected) / (1 - expected), 4) AS kappa FROM s""")
def kappa_agreement(spark, d):
    rating = F.col("rating")
    rated = F.when(rating <= 2, "negative").when(rating == 3, "neutral").when(rating > 3, "positive")
    found = agreement.kappa(event_reviews(spark, d), F.col("sentiment"), rated)
    return found.select("n", *[r4(c).alias(c) for c in ("observed", "expected", "kappa")])


# languages

_BAYES = f"""{_DOC}, words AS (SELECT review_id, language, unnest(regexp_extract_all(regexp_replace(lower(coalesce(review_text, '')), '[^\\x{{0}}-\\x{{FFFF}}]', ' ', 'g'), '[\\p{{L}}\\p{{M}}]+')) AS w FROM doc),
seen AS (SELECT review_id, language, unnest(list_transform(range(1, length(w) + 1), lambda i: substring(' ' || w || ' ', i, 3))) AS gram FROM words),
learned AS (SELECT language AS label, gram, count(*) AS c FROM seen WHERE language IS NOT NULL AND review_id % 3 <> 1 GROUP BY 1, 2),
v AS (SELECT count(DISTINCT gram) AS v FROM learned), lab AS (SELECT language AS label, count(*) AS docs FROM doc WHERE language IS NOT NULL AND review_id % 3 <> 1 GROUP BY 1),
tot AS (SELECT label, docs, (SELECT coalesce(sum(c), 0) FROM learned l WHERE l.label = lab.label) + v AS t, round(ln(docs / (SELECT sum(docs) FROM lab)) * 1000000)::BIGINT AS prior FROM lab, v),
mine AS (SELECT review_id, gram, count(*) AS m FROM seen GROUP BY 1, 2),
sc AS (SELECT review_id, tot.label, any_value(prior) + sum(m * round(ln((coalesce(c, 0) + 1) / t) * 1000000)::BIGINT) AS s FROM mine CROSS JOIN tot LEFT JOIN learned l ON l.label = tot.label AND l.gram = mine.gram GROUP BY 1, 2),
bs AS (SELECT review_id, max(s) AS best FROM sc GROUP BY 1),
told AS (SELECT review_id, min(label) FILTER (s = best) AS told, 1 / sum(exp((s - best)::DOUBLE / 1000000)) AS probability FROM sc JOIN bs USING (review_id) GROUP BY 1),
bayes AS (SELECT review_id, language AS given, told AS language, probability FROM doc LEFT JOIN told USING (review_id))"""


def _bayes(spark, d):
    rows = document_reviews(spark, d).withColumnRenamed("language", "given")
    return L.review_languages(rows, "review_text", L.fit(rows.filter("review_id % 3 <> 1"), "review_text", "given"))


@query(f"""WITH {_BAYES}, h AS (SELECT review_id, regexp_extract_all(lower(coalesce(review_text, '')), '[a-z]+') AS ws FROM doc)
SELECT review_id, language, round(probability, 4) AS probability, CASE WHEN len(ws) = 0 THEN 'OTHER' WHEN {O._HINDI} / len(ws) > 0.2 THEN 'HINGLISH' WHEN language = 'en' THEN 'EN' ELSE 'OTHER' END AS kind FROM bayes JOIN h USING (review_id)""")
def language_bayes(spark, d):
    return _bayes(spark, d).select("review_id", "language", r4("probability").alias("probability"), "kind")


@query(f"WITH {_BAYES} SELECT given AS language, review_id % 3 = 1 AS held_out, count(*) AS reviews, count_if(language = given)::BIGINT AS told FROM bayes WHERE given IS NOT NULL GROUP BY 1, 2")
def language_accuracy(spark, d):
    kept = _bayes(spark, d).filter("given IS NOT NULL")
    return kept.groupBy(F.col("given").alias("language"), (F.col("review_id") % 3 == 1).alias("held_out")).agg(F.count("*").alias("reviews"), F.count_if(F.col("language") == F.col("given")).alias("told"))


# phrases by statistics

_INNER = f"{_LIST(S.PHRASE_STOP_WORDS)}"
_EMPTY = f"{_LIST([*S.PHRASE_STOP_WORDS, *S.PHRASE_PRODUCT_WORDS])}"
_PART = lambda k, r, c: f"CASE WHEN {k} > 0 THEN ({k}) * ln(({k})::DOUBLE * t / (({r})::DOUBLE * ({c}))) ELSE 0 END"
_PAIRS = f"""{_DOC}, sn AS (SELECT regexp_extract_all(unnest(regexp_split_to_array(lower(coalesce(review_text, '')), '[.!?;:,\\n\\r]+')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM doc),
pc AS (SELECT p[1] AS first, p[2] AS second, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]])) AS p FROM sn) GROUP BY 1, 2),
pm AS (SELECT *, sum(n) OVER (PARTITION BY first) AS l, sum(n) OVER (PARTITION BY second) AS r, sum(n) OVER () AS t FROM pc),
g AS (SELECT first, second, n, CASE WHEN n::DOUBLE * t >= l::DOUBLE * r THEN 1 ELSE -1 END * 2 * ({_PART("n", "l", "r")} + {_PART("l - n", "l", "t - r")} + {_PART("r - n", "t - l", "r")} + {_PART("t - l - r + n", "t - l", "t - r")}) AS g2 FROM pm WHERE n >= 5)"""
_CVALUES = f"""{_PAIRS}, rn AS (SELECT unnest(flatten(list_transform([2, 3, 4], lambda k: list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])))) AS ws FROM sn),
cc AS (SELECT ws, count(*) AS n FROM rn WHERE NOT list_contains({_INNER}, ws[1]) AND NOT list_contains({_INNER}, ws[len(ws)]) GROUP BY 1 HAVING count(*) >= 5),
cv AS (SELECT * FROM cc WHERE len(list_filter(ws, lambda x: NOT list_contains({_EMPTY}, x))) > 0 AND len(list_filter(ws, lambda x: NOT regexp_matches(x, '^[0-9]+$'))) > 0 AND len(list_filter(ws, lambda x: length(x) > 2)) > 0),
pp AS (SELECT ws, unnest(list_transform(range(1, len(ws)), lambda i: ws[i:i + 1])) AS pair FROM cv),
cd AS (SELECT cv.ws, any_value(cv.n) AS n FROM cv JOIN pp USING (ws) LEFT JOIN g ON g.first = pair[1] AND g.second = pair[2] AND g2 >= {P.SIGNIFICANT} GROUP BY cv.ws HAVING bool_and(g2 IS NOT NULL)),
sb AS (SELECT n, unnest(list_distinct(flatten(list_transform(range(2, len(ws)), lambda k: list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1]))))) AS ws FROM cd WHERE len(ws) > 2),
ar AS (SELECT ws, sum(n) AS around, count(*) AS longer FROM sb GROUP BY 1),
cw AS (SELECT array_to_string(ws, ' ') AS phrase, len(ws) AS words, n, coalesce(longer, 0) AS longer, round(1000 * log2(len(ws)) * (n - coalesce(around / longer, 0)))::BIGINT AS c_value FROM cd LEFT JOIN ar USING (ws))"""


@query(f"WITH {_PAIRS} SELECT first, second, n, round(g2, 4) AS g2 FROM g")
def phrase_neighbours(spark, d):
    return P.neighbours(P.sentences(document_reviews(spark, d))).withColumn("g2", r4("g2"))


@query(f"WITH {_CVALUES} SELECT phrase, words, n, longer, c_value FROM cw")
def phrase_values(spark, d):
    return P.c_values(P.candidates(P.sentences(document_reviews(spark, d))))


def _segments(spark, d):
    rows = P.sentences(document_reviews(spark, d)).select("review_id", "sentence")
    return P.segmented(rows, P.c_values(P.candidates(rows)))


@query(None)
def phrase_segments(spark, d):
    """Phrases that the segmentation of all reviews uses, by reviews in the later and the earlier half of the ids."""
    rows = _segments(spark, d)
    half = document_reviews(spark, d).agg((F.max("review_id") / 2).alias("half"))
    return P.segment_frequency(rows.join(F.broadcast(half)), F.col("review_id") > F.col("half"))


@query(None)
def phrase_segments_emerging(spark, d):
    return vocabulary.emerging_phrases(phrase_segments(spark, d))


# encodings


@query("SELECT doc_id AS review_id, md5(text) AS text_md5 FROM documents")
def text_descrambled(spark, d):
    """Every text read wrongly 0 to 3 times by turns, as Latin-1 or windows-1252, and repaired."""
    def scrambled(text, windows):
        latin = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
        return F.translate(latin, X._CONTROLS, X._SPECIALS) if windows else latin

    times, rows = F.col("review_id") % 4, document_reviews(spark, d).withColumn("t", F.col("review_text"))
    for k in range(3):
        rows = rows.withColumn("t", F.when(times > k, F.when(F.col("review_id") % 3 == 0, scrambled(F.col("t"), False)).otherwise(scrambled(F.col("t"), True))).otherwise(F.col("t")))
    return rows.select("review_id", F.md5(X.descrambled(F.col("t"))).alias("text_md5"))


# lexicons and kept responses

_TERMS = sorted({t.lower() for e in S.EMOTIONS for t in e[5]} | set(C.KEY_TEST) | set(S.PHRASE_STOP_WORDS) | set(S.HINDI_WORDS))


@query(f"WITH {_DOC}, k AS (SELECT unnest(list_filter({_LIST(_TERMS)}, lambda k: contains(lower(review_text), k))) AS term FROM doc) SELECT term, count(*) AS reviews FROM k GROUP BY 1")
def lexicon_terms(spark, d):
    held = document_reviews(spark, d).select(F.explode(lexicon.held_terms(F.lower("review_text"), _TERMS)).alias("term"))
    return held.groupBy("term").agg(F.count("*").alias("reviews"))


@query(f"""WITH {_DOC}, c AS (SELECT CASE WHEN review_id % 2 = 0 THEN 'second' WHEN review_id % 3 = 0 THEN 'first' ELSE 'asked' END AS response, review_id FROM doc)
SELECT response, count(*) AS reviews, min(review_id) AS first_id FROM c GROUP BY 1""")
def kept_responses(spark, d):
    """Two batches that overlap, the newer one counts; what neither holds is asked."""
    rows, content = document_reviews(spark, d).select("review_id", "language"), ["review_id", "language"]
    store = responses.Responses(spark, fresh_path(spark, "responses"))
    batch = lambda some, name, at: some.select(sinks.cache_key(content).alias("key"), F.lit(name).alias("response"), F.lit(at).cast("timestamp").alias("stored_at"))
    store.put(batch(rows.filter("review_id % 2 = 0"), "second", "2024-01-02"))
    store.put(batch(rows.filter("review_id % 3 = 0"), "first", "2024-01-01"))
    told = store.answered(rows, content, lambda _: F.lit("asked"))
    return told.groupBy("response").agg(F.count("*").alias("reviews"), F.min("review_id").alias("first_id"))


@query(f"""WITH {_DOC}, b AS (SELECT review_id, review_id // 5 AS batch, (review_id // 5) % 4 AS kind, review_id % 3 <> 2 AS told FROM doc)
SELECT review_id, batch, CASE WHEN kind = 0 AND told THEN 'positive' ELSE 'neutral' END AS overall_sentiment, CASE WHEN kind = 0 AND told THEN 'F' || (review_id % 6) END AS feature,
NOT (kind = 0 AND told) AS human_review_needed, CASE WHEN kind = 1 THEN '{S.NO_JSON}' WHEN kind >= 2 THEN '{S.NO_RESULTS.replace("'", "''")}' WHEN NOT told THEN '{S.MISSING_RESULT}' END AS error_message FROM b""")
def validated_extractions(spark, d):
    """Answers for batches of five reviews: fenced JSON that lacks some reviews, cut JSON, JSON without or with a wrong list."""
    rows = document_reviews(spark, d).select("review_id", F.expr("review_id div 5").alias("batch"))
    one = F.struct(F.col("review_id"), F.lit("positive").alias("overall_sentiment"), F.array(F.struct(F.concat(F.lit("F"), F.col("review_id") % 6).alias("feature"), F.lit("positive").alias("sentiment"))).alias("features"))
    answers = rows.groupBy("batch").agg(F.to_json(F.struct(F.collect_list(F.when(F.col("review_id") % 3 != 2, one)).alias("results"))).alias("json"))
    kind = F.col("batch") % 4
    content = F.when(kind == 0, F.concat(F.lit("```json\n"), "json", F.lit("\n```"))).when(kind == 1, F.concat(F.lit("{"), "json")).when(kind == 2, '{"data": []}').otherwise('{"results": "none"}')
    told = R.validated_extractions(rows, answers.select("batch", content.alias("content")))
    return told.select("review_id", "batch", "overall_sentiment", F.get("features", F.lit(0))["feature"].alias("feature"), "human_review_needed", "error_message")


@query(f"""WITH s AS (SELECT *, review_id % 4 = 1 AS bad FROM {of('bot_scores')}), p AS (SELECT review_id, bot_score + CASE WHEN bad THEN 10 ELSE 0 END AS bot_score, concat_ws(',', nullif(signals, ''), CASE WHEN bad THEN 'UNVERIFIED_PURCHASE' END) AS signals FROM s)
SELECT review_id, bot_score, signals, CASE WHEN bot_score <= 25 THEN 'TRUSTED' WHEN bot_score <= 50 THEN 'LOW_SUSPICION' WHEN bot_score <= 75 THEN 'HIGH_SUSPICION' ELSE 'CONFIRMED_BOT' END AS status FROM p""")
def bot_unverified(spark, d):
    verified = F.when(F.col("review_id") % 4 == 0, "True").when(F.col("review_id") % 4 == 1, "False")
    found = _bot_rows(spark, d).select("review_id", X.bot_signals(F.col("review_text"), F.col("rating"), F.col("username"), verified).alias("s"))
    score = F.least(F.lit(100), F.aggregate("s", F.lit(0), lambda a, x: a + x["points"]))
    return found.select("review_id", score.alias("bot_score"), F.array_join(F.transform("s", lambda x: x["signal"]), ",").alias("signals"), X.bot_status(score).alias("status"))
