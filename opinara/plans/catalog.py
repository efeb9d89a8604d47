"""One query per operator of the survey, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from opinara import schema as S
from opinara.functions import text as X
from opinara.functions.numbers import percent, rounded as r4
from opinara.operators import duplicates as D, escalation as E, trends as T, weekly as W
from opinara.operators.ordering import positions
from opinara.plans.views import LINE_ORDER, document_reviews, event_reviews, line_reviews, table
from opinara.storage import stored

QUERIES = {}
#: Frequent words of the test texts stand in for the review word lists, which hardly occur in them.
NEG_TEST, POS_TEST, KEY_TEST = ["the", "der", "que", "und"], ["and", "is", "la", "en"], ["the", "and", "ich", "que", "le", "ion", "xyzzy"]
STOP_TEST = ["the", "and", "of", "to", "in"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def _rates(spark: SparkSession, d: str) -> DataFrame:
    return T.window_rates(line_reviews(spark, d), LINE_ORDER)


@query
def trend_sliding_rates(spark, d):
    return _rates(spark, d).select("product_name", "feature", "window_no", "total_mentions", "negative_mentions", *[r4(c).alias(c) for c in ("complaint_rate", "praise_rate", "neutral_rate", "mixed_rate")])


@query
def trend_zscore(spark, d):
    return T.z_scores(_rates(spark, d)).select("product_name", "feature", "window_no", r4("complaint_rate").alias("complaint_rate"), r4("baseline_rate").alias("baseline_rate"), r4("z_score").alias("z_score"))


@query
def trend_emerging(spark, d):
    return T.emerging(_rates(spark, d)).filter("is_emerging").select("product_name", "feature", "window_no", r4("complaint_rate").alias("complaint_rate"), r4("baseline_rate").alias("baseline_rate"))


def _directions(spark, d):
    return T.directions(_rates(spark, d))


@query
def trend_direction(spark, d):
    return _directions(spark, d).select("product_name", "feature", "windows", r4("slope").alias("slope"), r4("max_severity").alias("max_severity"), "any_emerging", r4("latest_rate").alias("latest_rate"), "direction")


@query
def trend_summary(spark, d):
    return _directions(spark, d).agg(F.count("*").alias("series"), F.count_if("any_emerging").alias("emerging"), F.count_if(F.col("direction") == "spiking").alias("spiking"), F.count_if(F.col("direction") == "declining").alias("declining"), F.count_if(F.col("max_severity") > S.Z_ANOMALY).alias("anomalous"))


def _stages(spark, d):
    return T.lifecycle(_rates(spark, d), base=20.0)


@query
def lifecycle_stage(spark, d):
    return _stages(spark, d).select("product_name", "feature", "window_no", "stage", "severity")


@query
def lifecycle_transitions(spark, d):
    return T.transitions(_stages(spark, d)).select("product_name", "feature", "window_no", "from_stage", "stage")


@query
def lifecycle_summary(spark, d):
    last = _stages(spark, d).groupBy("product_name", "feature").agg(F.max_by(F.struct("stage", "severity"), "window_no").alias("x")).select("x.*")
    return last.groupBy("stage").agg(F.count("*").alias("issues"), F.max("severity").alias("max_severity"), F.count_if(F.col("stage").isin("systemic", "persistent")).alias("need_attention"))


def _issues(spark, d):
    return E.scored(E.product_issues(line_reviews(spark, d)))


@query
def escalation_factors(spark, d):
    return _issues(spark, d).select("product_name", "feature", "mentions", "negatives", *[r4(c).alias(c) for c in ("rate", "severity", "velocity", "frequency", "confidence_factor", "reach", "recency")])


@query
def escalation_rank(spark, d):
    rows = _issues(spark, d).select("product_name", "feature", r4("priority", 2).alias("priority"), "level")
    return rows.orderBy(F.desc("priority"), "product_name", "feature").limit(20)


@query
def escalation_top3_per_product(spark, d):
    rows = _issues(spark, d).withColumn("priority", r4("priority", 2))
    return E.top_per(rows, ["product_name"], [F.desc("priority"), F.col("feature")], 3).select("product_name", "rank", "feature", "priority", "level")


@query
def escalation_summary(spark, d):
    rows = _issues(spark, d).withColumn("priority", r4("priority", 2))
    return rows.agg(*[F.count_if(F.col("level") == n).alias(n) for n, _ in S.PRIORITY_LEVELS], r4(F.avg("priority"), 2).alias("average"), F.max("priority").alias("top"))


@query
def decision_mode(spark, d):
    rows = _issues(spark, d).withColumn("priority", r4("priority", 2)).filter("priority >= 40 AND product_name = 'Brand#11'")
    return rows.orderBy(F.desc("priority"), "feature").limit(3).select("product_name", "feature", "priority", "level", E.primary_team(F.col("feature")).alias("team"))


@query
def team_routing(spark, d):
    rows = table(spark, d, "events").select(F.concat(F.element_at(F.array(*map(F.lit, ("packaging_", "battery ", "price-", "Delivery", "other"))), (F.col("user_id") % 5 + 1).cast("int")), F.col("event_type")).alias("feature"))
    return rows.groupBy(E.primary_team(F.col("feature")).alias("team")).agg(F.count("*").alias("issues"))


@query
def category_detect(spark, d):
    rows = table(spark, d, "part").select(F.concat(F.element_at(F.array(*map(F.lit, ("Smart Bottle ", "Charger ", "Nutri ", "Lamp "))), (F.col("p_partkey") % 4 + 1).cast("int")), F.col("p_name")).alias("name"))
    return rows.groupBy(E.category(F.col("name")).alias("category")).agg(F.count("*").alias("products"))


@query
def team_action_plan(spark, d):
    last = _stages(spark, d).groupBy("product_name", "feature").agg(F.max_by("stage", "window_no").alias("stage"))
    issues = _issues(spark, d).select("product_name", "feature", "level").join(last, ["product_name", "feature"])
    return E.actions_for(issues).select("product_name", "feature", "stage", "team", "action_no", "action")


def _weeks(spark, d):
    return W.weekly_metrics(line_reviews(spark, d))


@query
def weekly_metrics(spark, d):
    return _weeks(spark, d).select("product_name", F.col("week_end").cast("string").alias("week_end"), "volume", *[r4(c).alias(c) for c in ("avg_rating", "complaint_rate", "sentiment_score")])


@query
def weekly_zscores(spark, d):
    return W.weekly_z(_weeks(spark, d)).select("product_name", "week_no", *[r4(f"z_{c}").alias(f"z_{c}") for c in ("avg_rating", "complaint_rate", "volume")])


@query
def weekly_anomalies(spark, d):
    return W.weekly_anomalies(_weeks(spark, d)).select("product_name", "week_no", "type", r4("z").alias("z"), r4("metric").alias("metric"), r4("baseline").alias("baseline"))


@query
def silent_growth(spark, d):
    return W.silent_growth(_weeks(spark, d), 0.5).select("product_name", "week_no", r4("z_complaint_rate").alias("z_complaint_rate"))


def _features(spark, d):
    return [f"F{k}" for k in range(6)], event_reviews(spark, d).withColumn("feature", F.concat(F.lit("F"), F.col("feature_no")))


@query
def feature_heatmap(spark, d):
    names, rows = _features(spark, d)
    return W.feature_heatmap(rows, names).select("product_name", F.col("week_end").cast("string").alias("week_end"), "feature", r4("rate").alias("rate"), r4("z").alias("z"))


def _batch_columns(df):
    return df.select("product_name", "batch_no", "reviews", *[r4(c).alias(c) for c in ("avg_rating", "positive_rate", "complaint_rate", "rating_delta", "complaint_delta")], "status")


@query
def batch_time(spark, d):
    return _batch_columns(W.time_batches(event_reviews(spark, d), 7))


def _fixed(spark, d):
    return W.fixed_batches(positions(event_reviews(spark, d), ["product_name"], F.to_date("ts"), ["ts", "review_id"]), 100)


@query
def batch_fixed(spark, d):
    return _batch_columns(_fixed(spark, d))


@query
def degradation(spark, d):
    return W.degradation(_fixed(spark, d), good=1.0, poor=5.0).select("product_name", r4("first_rating", 1).alias("first_rating"), "degraded_at", r4("early").alias("early"), r4("recent").alias("recent"))


@query
def kpi_overview(spark, d):
    s = F.col("sentiment")
    return event_reviews(spark, d).agg(F.count("*").alias("reviews"), F.count("rating").alias("rated"), r4(F.sum("rating") / F.count("rating")).alias("avg_rating"), r4(percent(F.count_if(s == "negative"), F.count("*"))).alias("negative_pct"), r4(percent(F.count_if(s == "positive"), F.count("*"))).alias("positive_pct"), F.countDistinct("product_name").alias("products"))


@query
def product_rating_alerts(spark, d):
    rows = event_reviews(spark, d).groupBy("product_name").agg((F.sum("rating") / F.count("rating")).alias("a"))
    return rows.select("product_name", r4("a").alias("avg_rating"), F.when(F.col("a") < 3.0, "CRITICAL").when(F.col("a") < 3.5, "WARNING").otherwise("OK").alias("alert"))


@query
def product_sentiment(spark, d):
    return event_reviews(spark, d).groupBy("product_name", "sentiment").agg(F.count("*").alias("reviews"))


@query
def value_counts_lang(spark, d):
    return document_reviews(spark, d).groupBy("language").agg(F.count("*").alias("reviews"))


@query
def distinct_products(spark, d):
    return document_reviews(spark, d).select("product_name").distinct()


@query
def unextracted_anti(spark, d):
    return document_reviews(spark, d).join(table(spark, d, "labels").select(F.col("doc_id").alias("review_id")), "review_id", "left_anti").select("review_id", "product_name")


@query
def features_inner(spark, d):
    rows = document_reviews(spark, d).join(table(spark, d, "labels").withColumnRenamed("doc_id", "review_id"), "review_id")
    return rows.groupBy("product_name").agg(F.count("*").alias("labelled"), F.sum("toxic").cast("long").alias("toxic"), F.sum("quality").cast("long").alias("good"))


@query
def reviews_nested_features(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat_ws(":", x["turn"], x["role"])), ",").alias("turns"))
    docs = document_reviews(spark, d).select("review_id")
    return docs.join(turns, F.col("review_id") == F.col("conv_id"), "left").select("review_id", F.coalesce("turns", F.lit("")).alias("turns"))


@query
def bot_user_anti(spark, d):
    rows = event_reviews(spark, d)
    bots = rows.groupBy("username").agg(F.count_if(F.col("sentiment") == "negative").alias("bad"), F.count("*").alias("n")).filter("bad * 4 > n").select("username")
    return rows.join(bots, "username", "left_anti").groupBy("product_name").agg(F.count("*").alias("reviews"))


@query
def keyword_rates(spark, d):
    rows = document_reviews(spark, d)
    found = rows.select(F.explode(F.filter(X.literal_array(KEY_TEST), lambda k: F.contains(F.lower("review_text"), k))).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("c"))
    total = rows.agg(F.count("*").alias("n"))
    rate = F.col("c") / F.col("n") * 100
    out = found.join(F.broadcast(total)).select("keyword", F.col("c").alias("reviews"), r4(rate).alias("rate"), F.when(rate > 25, "SYSTEMIC").when(rate > 15, "EMERGING").otherwise("MONITOR").alias("status"), F.floor(F.least(rate * 2.5, F.lit(100.0))).cast("int").alias("score"))
    return out.orderBy(F.desc("reviews"), "keyword").limit(3)


@query
def keyword_top_issue(spark, d):
    rows = document_reviews(spark, d).select("product_name", F.explode(F.filter(X.literal_array(KEY_TEST), lambda k: F.contains(F.lower("review_text"), k))).alias("keyword")).groupBy("product_name", "keyword").agg(F.count("*").alias("n"))
    place = F.array_position(X.literal_array(KEY_TEST), F.col("keyword"))
    return E.top_per(rows, ["product_name"], [F.desc("n"), place], 1).select("product_name", F.initcap("keyword").alias("top_word"), "n")


@query
def keyword_extraction(spark, d):
    from opinara.operators.extraction import keyword_features

    return keyword_features(document_reviews(spark, d), KEY_TEST, NEG_TEST, POS_TEST)


@query
def precision_recall(spark, d):
    flagged = document_reviews(spark, d).select(F.col("review_id").alias("doc_id"), (X.quality_score(F.col("review_text"), STOP_TEST, ["is"]) < 100).alias("low"))
    rows = flagged.join(table(spark, d, "labels").select("doc_id", (F.col("quality") == 0).alias("bad")), "doc_id")
    c = rows.agg(F.count_if(F.expr("low AND bad")).alias("tp"), F.count_if(F.expr("low AND NOT bad")).alias("fp"), F.count_if(F.expr("NOT low AND bad")).alias("fn"))
    return c.select("tp", "fp", "fn", r4(percent(F.col("tp"), F.col("tp") + F.col("fp")), 1).alias("precision"), r4(percent(F.col("tp"), F.col("tp") + F.col("fn")), 1).alias("recall"))


@query
def exact_dups(spark, d):
    return D.exact_duplicates(document_reviews(spark, d))


def _template(spark, d):
    low = F.lower("review_text")
    rows = document_reviews(spark, d).select("review_id", low.alias("low"), F.regexp_extract(low, X.WORD, 0).alias("word"))
    body = F.replace("low", F.col("word"), F.lit("[PRODUCT]"))
    return D.group_sizes(rows.select("review_id", F.when((F.col("word") != "") & X.has_words(F.trim(body), 5), body).alias("body")), F.col("body"), "matches", drop=["body"])


@query
def template_dups(spark, d):
    return _template(spark, d).filter("matches >= 3").select("review_id", "matches")


@query
def repetitive_sentences(spark, d):
    return document_reviews(spark, d).filter(D.repeated_sentence(F.col("review_text"))).select("review_id")


def _edges(spark, d):
    return D.pairs_of_vectors(D.tfidf_vectors(document_reviews(spark, d), STOP_TEST, S.DUPLICATE_SIMILARITY))


@query
def tfidf_edges(spark, d):
    return _edges(spark, d).select("a", "b", r4("similarity").alias("similarity"))


@query
def dup_components(spark, d):
    return D.text_groups(document_reviews(spark, d), STOP_TEST)


def _trust(spark, d):
    rows = document_reviews(spark, d)
    exact = D.group_sizes(rows.select("review_id", "review_text", D.repeated_sentence(F.col("review_text")).alias("repetitive")), D.normal_form(F.col("review_text")), "copies", drop=["review_text"])
    template = _template(spark, d).select("review_id", "matches")
    groups = D.text_groups(rows, STOP_TEST)
    out = exact.join(template, "review_id").join(groups, "review_id", "left")
    score = D.trust(F.coalesce("group_size", F.lit(0)), F.col("copies") > 1, F.col("repetitive"), F.col("matches") >= 3)
    flagged = (F.col("copies") > 1) | F.col("repetitive") | (F.col("matches") >= 3)
    return out.select("review_id", "group_id", score.alias("trust_score"), ((score < 30) | flagged).alias("is_suspicious"))


@query
def trust_scores(spark, d):
    return _trust(spark, d)


@query
def dedup_stats(spark, d):
    t, rows = F.col("trust_score"), stored(_trust(spark, d), "trust")
    largest = rows.filter("group_id IS NOT NULL").groupBy("group_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("largest_group"))
    return rows.agg(F.count("*").alias("reviews"), F.count_if("is_suspicious").alias("suspicious"), F.count_if(t >= 90).alias("trusted"), F.count_if((t >= 70) & (t < 90)).alias("minor"), F.count_if((t >= 40) & (t < 70)).alias("questionable"), F.count_if(t < 40).alias("bots"), F.countDistinct("group_id").alias("groups")).crossJoin(largest)


@query
def bot_scores(spark, d):
    rows = document_reviews(spark, d).withColumns({"rating": F.col("review_id") % 5 + 1, "username": F.when(F.col("review_id") % 3 == 0, F.concat(F.lit("user_"), F.col("review_id")))})
    found = rows.select("review_id", X.bot_signals(F.col("review_text"), F.col("rating"), F.col("username")).alias("s"))
    score = F.aggregate("s", F.lit(0), lambda a, x: a + x["points"])
    return found.select("review_id", score.alias("bot_score"), X.bot_status(score).alias("status"), F.array_join(F.transform("s", lambda x: x["signal"]), ",").alias("signals"))


@query
def burst_candidates(spark, d):
    return D.bursts(event_reviews(spark, d)).select("review_id", "product_name", "in_window", "campaign_rating")


@query
def burst_campaigns(spark, d):
    return D.greedy_bursts(event_reviews(spark, d))


@query
def sequential_users(spark, d):
    return D.sequential_users(event_reviews(spark, d).filter("rating = 1"))


def _emotions(spark, d):
    tests = [(n, w, u, lo, hi, [KEY_TEST[i % 6], NEG_TEST[i % 4]]) for i, (n, w, u, lo, hi, _) in enumerate(S.EMOTIONS)]
    rows = document_reviews(spark, d)
    return rows.select("review_id", X.emotion(F.col("review_text"), F.lit("negative"), tests).alias("e")).select("review_id", "e.*")


@query
def emotion_scores(spark, d):
    return _emotions(spark, d).select("review_id", "emotion", "confidence", "urgency", F.col("raw_score").cast("int").alias("raw_score"))


@query
def emotion_distribution(spark, d):
    names = spark.createDataFrame([(e[0],) for e in S.EMOTIONS], "emotion string")
    return F.broadcast(names).join(_emotions(spark, d).groupBy("emotion").agg(F.count("*").alias("n")), "emotion", "left").select("emotion", F.coalesce("n", F.lit(0)).alias("reviews"))


@query
def emotion_timeline(spark, d):
    rows = _emotions(spark, d).select((F.floor(F.col("review_id") / 100) + 1).alias("window_no"), "emotion")
    return rows.groupBy("window_no").pivot("emotion", [e[0] for e in S.EMOTIONS]).count().fillna(0)


@query
def sarcasm_pass1(spark, d):
    return document_reviews(spark, d).select("review_id", X.sarcasm(F.col("review_text")).alias("s")).select("review_id", "s.flags", r4("s.confidence").alias("confidence"))


@query
def local_sentiment(spark, d):
    rating = F.when(F.col("review_id") % 4 == 0, F.col("review_id") % 5 + 1)
    return document_reviews(spark, d).select("review_id", X.local_sentiment(F.col("review_text"), rating, NEG_TEST, POS_TEST).alias("sentiment"))


@query
def text_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", X.squeezed(F.col("html")).alias("clean_text"))


@query
def quality_score(spark, d):
    return document_reviews(spark, d).select("review_id", X.quality_score(F.col("review_text"), ["the", "der"], ["is", "la"]).alias("score"))


@query
def quality_histogram(spark, d):
    s = X.quality_score(F.col("review_text"), ["the", "der"], ["is", "la"])
    return document_reviews(spark, d).groupBy(F.floor(s / 5).alias("bin")).agg(F.count("*").alias("reviews"))


@query
def vocab_emerging(spark, d):
    rows = document_reviews(spark, d)
    half = rows.agg((F.max("review_id") / 2).alias("half"))
    ws = F.regexp_extract_all(F.lower("review_text"), F.lit(X.WORD), F.lit(0))
    pairs = rows.withColumn("w", ws).withColumn("p", F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 1)), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))).filter("size(w) > 1")
    df = pairs.join(F.broadcast(half)).select((F.col("review_id") > F.col("half")).alias("current"), F.explode(F.array_distinct("p")).alias("phrase")).groupBy("phrase").agg(F.count_if("current").alias("current"), F.count_if(~F.col("current")).alias("baseline"))
    return df.filter("current >= 5 AND baseline < 2").select("phrase", "current", "baseline", (F.col("current") - F.col("baseline")).alias("score"))


@query
def revenue_scenarios(spark, d):
    from opinara.operators.scenarios import revenue_scenarios as scenarios

    rows = event_reviews(spark, d).groupBy("product_name").agg((F.sum("rating") / F.count("rating")).alias("rating"), percent(F.count_if(F.col("sentiment") == "negative"), F.count("*")).alias("rate"), F.sum("value").alias("revenue"))
    return scenarios(rows, 8.0).select("product_name", "scenario", r4("new_rating", 1).alias("new_rating"), r4("revenue_impact", 0).alias("revenue_impact"))


@query
def crisis_inject(spark, d):
    from opinara.operators.scenarios import crisis_metrics, crisis_reviews

    base = document_reviews(spark, d).select("review_id", "product_name", F.when(F.col("review_id") % 8 == 0, "negative").otherwise("positive").alias("sentiment"))
    batch = crisis_reviews(spark, "packaging_crisis", "src1", "2024-01-01 00:00:00").select("product_name", "sentiment", "is_crisis")
    return crisis_metrics(base.unionByName(batch, allowMissingColumns=True))


@query
def reply_queue(spark, d):
    rows = event_reviews(spark, d).filter(F.col("sentiment") == "negative").withColumn("urgency", F.when(F.col("value") > 300, 0.9).when(F.col("value") > 100, 0.6).otherwise(0.3))
    return rows.orderBy(F.desc("urgency"), "review_id").limit(20).select("review_id", "product_name", "urgency", E.primary_team(F.col("product_name")).alias("team"))


@query
def paste_parse(spark, d):
    from opinara.sources.paste import pasted_reviews

    return pasted_reviews(table(spark, d, "conversations"), "text", ["conv_id", "turn"])


@query
def cross_product(spark, d):
    rows = line_reviews(spark, d).groupBy("feature", "product_name").agg(F.count("*").alias("n"), F.count_if(F.col("sentiment") == "negative").alias("bad"))
    hot = rows.filter(F.col("bad") / F.col("n") >= 0.33)
    return hot.groupBy("feature").agg(F.count("*").alias("products")).filter("products >= 2")


@query
def product_feature_heatmap(spark, d):
    rows = line_reviews(spark, d).groupBy("product_name", "feature").agg(F.count("*").alias("mentions"), F.count_if(F.col("sentiment") == "negative").alias("bad"))
    return rows.select("product_name", "feature", "mentions", F.when(F.col("mentions") >= 5, r4(F.col("bad") / F.col("mentions") * 100)).alias("complaint_rate"))


@query
def stream_weekly(spark, d):
    from opinara.streaming.weekly import run_weekly

    return run_weekly(spark, d)


def _frequency(spark, d):
    from opinara.operators.vocabulary import phrase_frequency

    rows = document_reviews(spark, d)
    half = rows.agg((F.max("review_id") / 2).alias("half"))
    return phrase_frequency(rows.join(F.broadcast(half)), F.col("review_id") > F.col("half"), 3)


@query
def phrase_frequency(spark, d):
    return _frequency(spark, d).filter("current + baseline >= 3")


@query
def phrase_emerging(spark, d):
    from opinara.operators.vocabulary import emerging_phrases

    return emerging_phrases(_frequency(spark, d), 3, 2)


@query
def phrase_novel(spark, d):
    from opinara.operators.vocabulary import emerging_phrases, novel_phrases

    return novel_phrases(emerging_phrases(_frequency(spark, d), 3, 2), KEY_TEST[:5]).select("phrase", "emergence_score")


@query
def vocabulary_alert(spark, d):
    from opinara.operators.vocabulary import emerging_phrases, vocabulary_alert as alert

    return alert(emerging_phrases(_frequency(spark, d), 3, 2), "all", "W2", 3)


def _text_campaigns(spark, d):
    from opinara.operators.campaigns import text_campaigns

    return text_campaigns(D.text_groups(document_reviews(spark, d), STOP_TEST, 0.65, max_features=2000))


@query
def text_campaigns(spark, d):
    return _text_campaigns(spark, d)


@query
def username_campaigns(spark, d):
    from opinara.operators.campaigns import username_campaigns as campaigns

    return campaigns(D.sequential_users(event_reviews(spark, d).filter("rating = 1")))


@query
def campaign_union(spark, d):
    from opinara.operators.campaigns import burst_campaigns as bursts, username_campaigns as names

    rows = event_reviews(spark, d)
    return bursts(D.greedy_bursts(rows)).unionByName(names(D.sequential_users(rows.filter("rating = 1")))).unionByName(_text_campaigns(spark, d))


def _members(spark, d):
    rows = D.user_islands(event_reviews(spark, d).filter("rating = 1")).withColumn("campaign_id", F.concat_ws("#", "prefix", "island"))
    big = rows.groupBy("campaign_id").agg(F.count("*").alias("n")).filter("n >= 3")
    return rows.join(big, "campaign_id").select("campaign_id", "username", F.lit(75).alias("confidence"))


@query
def network_nodes(spark, d):
    from opinara.operators.campaigns import network_nodes as nodes

    others = event_reviews(spark, d).groupBy("username").agg(F.count_if(F.col("rating") == 1).alias("n")).select("username", X.bot_status(F.col("n") * 10).alias("status"))
    return nodes(_members(spark, d), others)


@query
def network_edges(spark, d):
    from opinara.operators.campaigns import network_edges as edges

    return edges(_members(spark, d)).select("from_user", "to_user")


@query
def bot_exact_copies(spark, d):
    rows = document_reviews(spark, d).select("review_id", X.text_key(F.col("review_text")).alias("text_key"))
    return rows.groupBy("text_key").agg(F.min("review_id").alias("kept_id"), (F.count("*") - 1).alias("removed")).filter("removed > 0")


@query
def reply_drafts(spark, d):
    from opinara.operators.replies import reply_drafts as drafts

    feature = F.element_at(F.array(*map(F.lit, ("Seal", "build", "transit", "price"))), (F.col("review_id") % 4 + 1).cast("int"))
    return drafts(document_reviews(spark, d).select("review_id", "product_name", feature.alias("feature")))


@query
def surprise_sentiments(spark, d):
    names = spark.createDataFrame([(s,) for s in ("positive", "negative", "neutral", "mixed")], "sentiment string")
    counts = event_reviews(spark, d).groupBy("sentiment").agg(F.count("*").alias("n"))
    return F.broadcast(names).join(counts, "sentiment", "left").select("sentiment", F.coalesce("n", F.lit(0)).alias("reviews"))


def _surprise(spark, d):
    bad = line_reviews(spark, d).filter("sentiment = 'negative'").groupBy("feature").agg(F.count("*").alias("complaints"), F.avg(F.coalesce("intensity", F.lit(0.5))).alias("i"))
    return bad.orderBy(F.desc("complaints"), "feature").limit(5)


@query
def surprise_issues(spark, d):
    return _surprise(spark, d).select("feature", "complaints", r4("i").alias("avg_intensity"))


@query
def review_language(spark, d):
    return document_reviews(spark, d).select("review_id", X.review_language(F.col("review_text")).alias("language"))


@query
def text_repair(spark, d):
    return document_reviews(spark, d).select("review_id", F.md5(X.repaired(X.composed(X.unscrambled(F.col("review_text"))))).alias("repaired_md5"))


@query
def abbreviation_expand(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", X.expanded(F.concat_ws(" ", F.lit("Gr8 pls"), F.col("text"), F.lit("bcz bahut mast"))).alias("text"))


@query
def emotion_urgency(spark, d):
    return _emotions(spark, d).groupBy("urgency").agg(F.count("*").alias("reviews"), F.min("review_id").alias("first_id"))


@query
def window_status(spark, d):
    rate = F.col("complaint_rate")
    return _rates(spark, d).groupBy("product_name", F.when(rate > 30, "ALERT").when(rate >= 25, "WATCH").otherwise("OK").alias("status")).agg(F.count("*").alias("windows"))


@query
def executive_summary(spark, d):
    rows = _issues(spark, d).withColumn("priority", r4("priority", 2))
    counts = rows.groupBy("product_name").agg(*[F.count_if(F.col("level") == n).alias(n) for n in ("critical", "high")], F.count("*").alias("issues"), F.min(F.struct((-F.col("priority")).alias("p"), "feature"))["feature"].alias("top"))
    return counts.select("product_name", F.format_string("%d issues (%d critical, %d high); top: %s", "issues", "critical", "high", "top").alias("summary"))
