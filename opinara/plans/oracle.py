"""The same queries as DuckDB SQL, written apart from the DataFrame programs."""

from __future__ import annotations

from opinara import schema as S

_ORDER = "l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"
_RV = """rv AS (SELECT p_brand AS product_name, p_type AS feature, CASE l_returnflag WHEN 'R' THEN 'negative' WHEN 'A' THEN 'positive' ELSE 'neutral' END AS sentiment,
  (1 + floor((l_quantity - 1) / 10))::INTEGER AS rating, l_shipdate AS ts, l_discount * 10 AS intensity, 1 - l_tax AS confidence, lineitem.* FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_EV = """ev AS (SELECT event_id AS review_id, 'P' || (user_id % 5) AS product_name, 'user_' || user_id AS username, ts, value, user_id,
  CASE event_type WHEN 'error' THEN 'negative' WHEN 'purchase' THEN 'positive' ELSE 'neutral' END AS sentiment,
  (5 - least(4, floor(value / 25)))::INTEGER AS rating, (json_extract(props, '$.k')::INTEGER % 6) AS feature_no FROM events)"""
_DOC = "doc AS (SELECT doc_id AS review_id, source AS product_name, text AS review_text, lang AS language FROM documents)"
_RATES = f"""{_RV},
seq AS (SELECT *, row_number() OVER (PARTITION BY product_name ORDER BY {_ORDER}) - 1 AS idx, count(*) OVER (PARTITION BY product_name) AS n FROM rv),
win AS (SELECT *, unnest(generate_series(greatest(0, ceil((idx - 49) / 25.0))::BIGINT, least(floor(idx / 25.0), ceil(greatest(n - 50, 0) / 25.0))::BIGINT)) AS k FROM seq WHERE n >= 50),
rates AS (SELECT product_name, feature, (k + 1)::INTEGER AS window_no, count(*) AS total_mentions, count_if(sentiment = 'negative')::BIGINT AS negative_mentions,
  count_if(sentiment = 'negative') / count(*) * 100::DOUBLE AS complaint_rate, count_if(sentiment = 'positive') / count(*) * 100::DOUBLE AS praise_rate,
  count_if(sentiment = 'neutral') / count(*) * 100::DOUBLE AS neutral_rate
  FROM win WHERE least(k * 25 + 50, n) - k * 25 >= 25 GROUP BY 1, 2, 3),
z AS (SELECT *, max(CASE WHEN window_no = 1 THEN complaint_rate END) OVER s AS baseline_rate, stddev_pop(complaint_rate) OVER s AS sd, count(*) OVER s AS windows FROM rates WINDOW s AS (PARTITION BY product_name, feature)),
zz AS (SELECT *, CASE WHEN windows >= 2 THEN (complaint_rate - baseline_rate) / CASE WHEN sd < 1e-9 THEN 0.01 ELSE sd END END AS z_score,
  coalesce(CASE WHEN baseline_rate > 0 THEN complaint_rate / baseline_rate >= 2 WHEN complaint_rate > 0 THEN baseline_rate IS NOT NULL ELSE FALSE END AND complaint_rate - baseline_rate >= 10, FALSE) AS is_emerging FROM z),
dir0 AS (SELECT product_name, feature, count(*) AS windows, regr_slope(complaint_rate, i) AS slope, coalesce(max(abs(z_score)), 0) AS max_severity, bool_or(is_emerging) AS any_emerging, max_by(complaint_rate, window_no) AS latest_rate
  FROM (SELECT *, row_number() OVER (PARTITION BY product_name, feature ORDER BY window_no) - 1 AS i FROM zz) GROUP BY 1, 2),
dir AS (SELECT *, CASE WHEN windows < 2 THEN 'stable' WHEN coalesce(slope, 0) > 1 OR max_severity > 2.5 THEN 'spiking' WHEN coalesce(slope, 0) < -1 THEN 'declining' ELSE 'stable' END AS direction FROM dir0)"""
_STAGES = f"""{_RATES},
s1 AS (SELECT *, complaint_rate > 40 AS hi, lag(complaint_rate) OVER w AS prev, row_number() OVER w AS num, sum((complaint_rate > 40)::INT) OVER w AS total, sum((complaint_rate <= 40)::INT) OVER w AS island
  FROM rates WINDOW w AS (PARTITION BY product_name, feature ORDER BY window_no)),
s2 AS (SELECT *, sum(hi::INT) OVER (PARTITION BY product_name, feature, island ORDER BY window_no) AS run FROM s1),
s3 AS (SELECT *, max(run) OVER (PARTITION BY product_name, feature ORDER BY window_no) AS longest FROM s2),
s4 AS (SELECT *, CASE WHEN num = 1 THEN 'detected' WHEN complaint_rate <= 25 THEN 'resolved' WHEN complaint_rate < prev THEN 'resolving' WHEN total >= 3 AND complaint_rate >= prev THEN 'persistent'
  WHEN longest >= 2 THEN 'systemic' WHEN complaint_rate > prev THEN 'growing' ELSE 'detected' END AS stage FROM s3),
stages AS (SELECT *, (CASE stage WHEN 'resolved' THEN 0 ELSE least(100, CASE stage WHEN 'resolving' THEN 20 WHEN 'detected' THEN 40 WHEN 'growing' THEN 60 WHEN 'systemic' THEN 80 ELSE 100 END
  + CASE WHEN complaint_rate - 20 > 20 THEN 10 WHEN complaint_rate - 20 > 10 THEN 5 ELSE 0 END) END)::INTEGER AS severity FROM s4)"""
_ISSUES = f"""{_RV},
per AS (SELECT product_name, feature, count(*) AS mentions, count_if(sentiment = 'negative')::BIGINT AS negatives, avg(confidence) AS confidence FROM rv GROUP BY 1, 2),
f0 AS (SELECT *, sum(mentions) OVER (PARTITION BY product_name) AS total, negatives / mentions * 100::DOUBLE AS rate FROM per),
f1 AS (SELECT *, CASE WHEN rate > 20 THEN 100.0 ELSE 60.0 END::DOUBLE AS severity, least(100, greatest(0, rate - 5) * 10)::DOUBLE AS velocity, least(100, negatives / total * 100)::DOUBLE AS frequency, (confidence * 100)::DOUBLE AS confidence_factor,
  (CASE WHEN negatives > 20 THEN 100 WHEN negatives > 5 THEN 50 + (negatives - 5) / 15 * 50 ELSE greatest(20, negatives * 4) END)::DOUBLE AS reach, 100::DOUBLE AS recency FROM f0),
issues AS (SELECT *, round(.30 * severity + .25 * velocity + .20 * frequency + .15 * confidence_factor + .07 * reach + .03 * recency, 2)::DOUBLE AS priority FROM f1),
lv AS (SELECT *, CASE WHEN priority >= 80 THEN 'critical' WHEN priority >= 60 THEN 'high' WHEN priority >= 40 THEN 'medium' ELSE 'low' END AS level FROM issues)"""


def _r(c: str, n: int = 4, name: str | None = None) -> str:
    return f"(round(({c})::DOUBLE, {n}) + 0.0::DOUBLE) AS {name or c}"


def _weeks(source: str) -> str:
    return f"""wk0 AS (SELECT product_name, (date_trunc('week', ts - INTERVAL 1 DAY) + INTERVAL 7 DAY)::DATE AS week_end, count(rating) AS volume, sum(rating) / count(rating) AS avg_rating, count_if(rating <= 2) / count(rating) * 100::DOUBLE AS complaint_rate, count_if(rating >= 4) / count(rating) * 100::DOUBLE AS sentiment_score FROM {source} GROUP BY 1, 2),
wk1 AS (SELECT *, (row_number() OVER (PARTITION BY product_name ORDER BY week_end))::INTEGER AS week_no,
  {', '.join(f"count({c}) OVER p AS n_{c}, avg({c}) OVER p AS base_{c}, stddev_samp({c}) OVER p AS sd_{c}" for c in ("avg_rating", "complaint_rate", "volume"))}
  FROM wk0 WINDOW p AS (PARTITION BY product_name ORDER BY week_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
wk AS (SELECT *, {', '.join(f"CASE WHEN n_{c} >= 2 AND sd_{c} > 1e-9 THEN ({c} - base_{c}) / sd_{c} ELSE 0.0 END::DOUBLE AS z_{c}" for c in ("avg_rating", "complaint_rate", "volume"))} FROM wk1)"""


def _batches(key: str, rows: str) -> str:
    return f"""bt0 AS ({rows}),
bt1 AS (SELECT product_name, {key} AS p, count(*) AS reviews, sum(rating) / count(rating) AS avg_rating, count_if(rating >= 4) / count(*) * 100::DOUBLE AS positive_rate, count_if(rating <= 2) / count(*) * 100::DOUBLE AS complaint_rate FROM bt0 GROUP BY 1, 2),
bt2 AS (SELECT *, (row_number() OVER w)::INTEGER AS batch_no, coalesce(avg_rating - lag(avg_rating) OVER w, 0) AS rating_delta, coalesce(complaint_rate - lag(complaint_rate) OVER w, 0) AS complaint_delta FROM bt1 WINDOW w AS (PARTITION BY product_name ORDER BY p)),
bt AS (SELECT *, CASE WHEN rating_delta < -0.3 THEN 'RATING DROP' WHEN complaint_delta > 15 THEN 'COMPLAINT SPIKE' WHEN rating_delta < -0.1 OR complaint_delta > 5 THEN 'WATCH' ELSE 'STABLE' END AS status FROM bt2)"""


_BATCH_COLS = f"product_name, batch_no, reviews, {', '.join(_r(c) for c in ('avg_rating', 'positive_rate', 'complaint_rate', 'rating_delta', 'complaint_delta'))}, status"
_FIXED = _batches("idx // 100", "SELECT *, row_number() OVER (PARTITION BY product_name ORDER BY ts, review_id) - 1 AS idx FROM ev")
_LIST = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
_NEG, _POS, _KEY = ["the", "der", "que", "und"], ["and", "is", "la", "en"], ["the", "and", "ich", "que", "le", "ion", "xyzzy"]
_TEAM = lambda f: f"CASE WHEN regexp_matches(lower({f}), 'packaging|delivery|shipping') THEN 'Operations' WHEN regexp_matches(lower({f}), 'battery|durability|performance|quality') THEN 'Quality' WHEN regexp_matches(lower({f}), 'price|value|cost|marketing') THEN 'Marketing' ELSE 'Support' END"


def _quality(text: str, product: list[str], personal: list[str]) -> str:
    return f"""q0 AS (SELECT review_id, {text} AS t, trim(regexp_replace(regexp_replace({text}, '\\[[^\\]]*\\]', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM doc),
q1 AS (SELECT *, CASE WHEN plain = '' THEN 0 ELSE len(string_split(plain, ' ')) END AS n, regexp_extract_all(lower(plain), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM q0),
q AS (SELECT review_id, (CASE WHEN coalesce(trim(t), '') = '' THEN 0 WHEN n = 0 THEN 15 WHEN n < 5 THEN 10 ELSE least(100, ceil(CASE WHEN n >= 20 THEN 80 ELSE 50 + n * 1.5 END + CASE WHEN list_has_any(ws, {_LIST(product)}) THEN 10 ELSE 0 END + CASE WHEN list_has_any(ws, {_LIST(personal)}) THEN 10 ELSE 0 END)) END)::INTEGER AS score FROM q1)"""


_Q1 = _quality("review_text", ["the", "der"], ["is", "la"])
_EMO = [(n, w, u, lo, hi, [_KEY[i % 6], _NEG[i % 4]]) for i, (n, w, u, lo, hi, _) in enumerate(S.EMOTIONS)]
_EMOTION = f"""e0 AS (SELECT review_id, review_text AS t, {', '.join(f"len(list_filter({_LIST(e[5])}, lambda k: contains(lower(review_text), k)))::INTEGER AS c_{e[0]}" for e in _EMO)},
  CASE WHEN length(regexp_replace(review_text, '[^\\p{{L}}]', '', 'g')) > 0 THEN length(regexp_replace(review_text, '[^\\p{{Lu}}]', '', 'g')) / length(regexp_replace(review_text, '[^\\p{{L}}]', '', 'g')) ELSE 0 END > 0.6 AS loud FROM doc),
e1 AS (SELECT *, {', '.join(f"c_{e[0]} * {e[1]}{' + CASE WHEN loud THEN 30 ELSE 0 END' if e[0] == 'furious' else ''} AS s_{e[0]}" for e in _EMO)} FROM e0),
e2 AS (SELECT *, {' + '.join(f's_{e[0]}' for e in _EMO)} AS total, greatest({', '.join(f's_{e[0]}' for e in _EMO)}) AS top FROM e1),
e3 AS (SELECT review_id, CASE WHEN coalesce(trim(t), '') = '' THEN 'neutral' WHEN total = 0 THEN 'disappointed' {' '.join(f"WHEN s_{e[0]} = top THEN '{e[0]}'" for e in _EMO)} END AS emotion,
  CASE WHEN coalesce(trim(t), '') = '' THEN 0.5 WHEN total = 0 THEN 0.3 ELSE round(CASE WHEN c_furious >= 2 OR loud OR c_delighted >= 3 THEN greatest(least(0.95, top / total), 0.85) ELSE least(0.95, top / total) END, 2) END::DOUBLE AS confidence FROM e2),
em AS (SELECT *, CASE emotion {' '.join(f"WHEN '{e[0]}' THEN '{e[2]}'" for e in _EMO)} END AS urgency, (CASE emotion {' '.join(f"WHEN '{e[0]}' THEN {e[3] + (e[4] - e[3]) // 2}" for e in _EMO)} END)::INTEGER AS raw_score FROM e3)"""
_UNIGRAMS = "SELECT review_id, unnest(ws) AS term FROM tw"
_BIGRAMS = "SELECT review_id, ws[i] || ' ' || ws[i + 1] AS term FROM (SELECT *, unnest(generate_series(1, len(ws) - 1)) AS i FROM tw WHERE len(ws) > 1)"


def _tfidf(terms, least, features=""):
    return f"""{_DOC},
tx AS (SELECT * FROM doc WHERE length(trim(review_text)) >= 10),
tw AS (SELECT review_id, list_filter(regexp_extract_all(lower(review_text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ('the', 'and', 'of', 'to', 'in')) AS ws FROM tx),
tf AS (SELECT review_id, term, count(*) AS tf FROM ({terms}) GROUP BY 1, 2),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM tx)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1 HAVING count(*) <= 0.95 * (SELECT count(*) FROM tx) {features}),
raw AS (SELECT review_id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
wt AS (SELECT review_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY review_id)) AS w FROM raw),
edge AS (SELECT x.review_id AS a, y.review_id AS b, sum(x.w * y.w) AS similarity FROM wt x JOIN wt y ON x.term = y.term AND x.review_id < y.review_id GROUP BY 1, 2 HAVING sum(x.w * y.w) {least})"""


_TFIDF = _tfidf(f"{_UNIGRAMS} UNION ALL {_BIGRAMS}", ">= 0.85")
_TOP_TERMS = "ORDER BY sum(tf) DESC, term LIMIT 2000"
_COMPONENTS = """
both_ AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach_ AS (SELECT a AS review_id, a AS c FROM both_ UNION SELECT both_.b, reach_.c FROM reach_ JOIN both_ ON both_.a = reach_.review_id),
grp0 AS (SELECT review_id, min(c) AS group_id FROM reach_ GROUP BY 1),
grp AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS group_size FROM grp0)"""
_GROUPS = f"{_TFIDF},{_COMPONENTS}"
_TEMPLATE = """tp0 AS (SELECT review_id, review_text, regexp_extract(lower(review_text), '[\\p{L}\\p{N}_]+', 0) AS word FROM doc),
tp1 AS (SELECT review_id, CASE WHEN word <> '' AND len(regexp_split_to_array(trim(replace(lower(review_text), word, '[PRODUCT]')), '\\s+')) >= 5 THEN replace(lower(review_text), word, '[PRODUCT]') END AS body FROM tp0),
tp AS (SELECT review_id, CASE WHEN body IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY body) END AS matches FROM tp1)"""
_SENT = """sn AS (SELECT review_id, list_filter(list_transform(regexp_split_to_array(lower(review_text), '[.!?]+'), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: length(s) > 5) AS ss FROM doc),
rep AS (SELECT review_id, len(list_distinct(ss)) < len(ss) AND (SELECT max(c) FROM (SELECT count(*) AS c FROM (SELECT unnest(ss) AS s) GROUP BY s)) >= 3 AS repetitive FROM sn)"""
_NORM = "lower(trim(regexp_replace(review_text, '\\s+', ' ', 'g')))"
_TRUST = f"""{_GROUPS}, {_TEMPLATE}, {_SENT},
cp AS (SELECT review_id, CASE WHEN length({_NORM}) > 0 THEN count(*) OVER (PARTITION BY {_NORM}) ELSE 0 END AS copies FROM doc),
tr0 AS (SELECT cp.review_id, group_id, copies > 1 AS ex, coalesce(repetitive, FALSE) AS rp, matches >= 3 AS tm, coalesce(group_size, 0) AS gs FROM cp JOIN tp USING (review_id) JOIN rep USING (review_id) LEFT JOIN grp USING (review_id)),
tr AS (SELECT review_id, group_id, greatest(0, 100 - CASE WHEN gs >= 2 THEN least(50, 20 + 5 * (gs - 2)) ELSE 0 END - CASE WHEN ex THEN 30 ELSE 0 END - CASE WHEN rp THEN 25 ELSE 0 END - CASE WHEN tm THEN 35 ELSE 0 END)::INTEGER AS trust_score, ex OR rp OR tm AS flagged FROM tr0)"""
_W = lambda ws, xs: f"len(list_filter({ws}, lambda w: list_contains({_LIST(xs)}, w)))"
_SARC = ", ".join(f"CASE WHEN regexp_matches(review_text, '{p.replace(chr(39), chr(39) * 2)}') THEN '{f}' END" for f, p, _ in S.SARCASM_RULES)

#: The greedy scan of bursts: an anchor's window starts at its own row, the next anchor stands beyond the last burst.
_BURSTS = """sb AS (SELECT product_name, review_id, rating, sec, row_number() OVER (PARTITION BY product_name ORDER BY sec, review_id) AS rn FROM (SELECT *, epoch(date_trunc('second', ts))::BIGINT AS sec FROM ev WHERE rating IS NOT NULL)),
qa AS (SELECT a.product_name, a.rn, a.sec, a.review_id AS campaign_id FROM sb a JOIN sb b ON b.product_name = a.product_name AND b.rn >= a.rn AND b.sec <= a.sec + 7200 GROUP BY ALL HAVING count(*) >= 3 AND min(b.rating) = max(b.rating) AND min(b.rating) IN (1, 5)),
nx AS (SELECT a.product_name, a.rn, a.sec, a.campaign_id, min(b.rn) AS nx FROM qa a LEFT JOIN qa b ON b.product_name = a.product_name AND b.sec > a.sec + 7200 GROUP BY ALL),
ch AS (SELECT * FROM nx WHERE rn = (SELECT min(f.rn) FROM qa f WHERE f.product_name = nx.product_name) UNION ALL SELECT n.* FROM ch JOIN nx n ON n.product_name = ch.product_name AND n.rn = ch.nx),
gb AS (SELECT sb.product_name, ch.campaign_id, sb.review_id, sb.rating FROM ch JOIN sb ON sb.product_name = ch.product_name AND sb.rn >= ch.rn AND sb.sec <= ch.sec + 7200)"""

SQL = {
    "trend_sliding_rates": f"WITH {_RATES} SELECT product_name, feature, window_no, total_mentions, negative_mentions, {_r('complaint_rate')}, {_r('praise_rate')}, {_r('neutral_rate')}, 0.0::DOUBLE AS mixed_rate FROM rates",
    "trend_zscore": f"WITH {_RATES} SELECT product_name, feature, window_no, {_r('complaint_rate')}, {_r('baseline_rate')}, {_r('z_score')} FROM zz",
    "trend_emerging": f"WITH {_RATES} SELECT product_name, feature, window_no, {_r('complaint_rate')}, {_r('baseline_rate')} FROM zz WHERE is_emerging",
    "trend_direction": f"WITH {_RATES} SELECT product_name, feature, windows, {_r('slope')}, {_r('max_severity')}, any_emerging, {_r('latest_rate')}, direction FROM dir",
    "trend_summary": f"WITH {_RATES} SELECT count(*) AS series, count_if(any_emerging)::BIGINT AS emerging, count_if(direction = 'spiking')::BIGINT AS spiking, count_if(direction = 'declining')::BIGINT AS declining, count_if(max_severity > 2.5)::BIGINT AS anomalous FROM dir",
    "lifecycle_stage": f"WITH {_STAGES} SELECT product_name, feature, window_no, stage, severity FROM stages",
    "lifecycle_transitions": f"WITH {_STAGES}, t AS (SELECT *, lag(stage, 1, 'detected') OVER (PARTITION BY product_name, feature ORDER BY window_no) AS from_stage FROM stages) SELECT product_name, feature, window_no, from_stage, stage FROM t WHERE from_stage <> stage",
    "lifecycle_summary": f"WITH {_STAGES}, t AS (SELECT *, row_number() OVER (PARTITION BY product_name, feature ORDER BY window_no DESC) AS r FROM stages) SELECT stage, count(*) AS issues, max(severity)::INTEGER AS max_severity, count_if(stage IN ('systemic', 'persistent'))::BIGINT AS need_attention FROM t WHERE r = 1 GROUP BY stage",
    "escalation_factors": f"WITH {_ISSUES} SELECT product_name, feature, mentions, negatives, {', '.join(_r(c) for c in ('rate', 'severity', 'velocity', 'frequency', 'confidence_factor', 'reach', 'recency'))} FROM lv",
    "escalation_rank": f"WITH {_ISSUES} SELECT product_name, feature, priority, level FROM lv ORDER BY priority DESC, product_name, feature LIMIT 20",
    "escalation_top3_per_product": f"WITH {_ISSUES}, t AS (SELECT *, (row_number() OVER (PARTITION BY product_name ORDER BY priority DESC, feature))::INTEGER AS rank FROM lv) SELECT product_name, rank, feature, priority, level FROM t WHERE rank <= 3",
    "escalation_summary": f"WITH {_ISSUES} SELECT {', '.join(f'''count_if(level = '{n}')::BIGINT AS {n}''' for n, _ in S.PRIORITY_LEVELS)}, round(avg(priority), 2) AS average, max(priority) AS top FROM lv",
    "decision_mode": f"WITH {_ISSUES} SELECT product_name, feature, priority, level, {_TEAM('feature')} AS team FROM lv WHERE priority >= 40 AND product_name = 'Brand#11' ORDER BY priority DESC, feature LIMIT 3",
    "team_routing": f"WITH t AS (SELECT ['packaging_', 'battery ', 'price-', 'Delivery', 'other'][(user_id % 5 + 1)::INTEGER] || event_type AS f FROM events) SELECT {_TEAM('f')} AS team, count(*) AS issues FROM t GROUP BY 1",
    "category_detect": "WITH t AS (SELECT lower(['Smart Bottle ', 'Charger ', 'Nutri ', 'Lamp '][(p_partkey % 4 + 1)::INTEGER] || p_name) AS f FROM part) SELECT CASE WHEN regexp_matches(f, 'bottle|care') THEN 'Personal Care' WHEN regexp_matches(f, 'charge|bolt|electronics') THEN 'Electronics' WHEN regexp_matches(f, 'mix|blend|nutri') THEN 'Food' ELSE 'General' END AS category, count(*) AS products FROM t GROUP BY 1",
    "team_action_plan": f"""WITH {_STAGES}, {_ISSUES[len(_RV) + 2:]}, last AS (SELECT product_name, feature, stage FROM (SELECT *, row_number() OVER (PARTITION BY product_name, feature ORDER BY window_no DESC) AS r FROM stages) WHERE r = 1),
act(stage, team, action_no, action) AS (VALUES {', '.join(f"('{s}', '{t}', {i + 1}, '{a}')" for s, ts in S.TEAM_ACTIONS.items() for t, xs in ts.items() for i, a in enumerate(xs))})
SELECT product_name, feature, stage, team, action_no::INTEGER AS action_no, CASE WHEN level = 'critical' THEN 'URGENT: ' || action ELSE action END AS action FROM lv JOIN last USING (product_name, feature) JOIN act USING (stage)""",
    "weekly_metrics": f"WITH {_RV}, {_weeks('rv')} SELECT product_name, week_end::VARCHAR AS week_end, volume, {_r('avg_rating')}, {_r('complaint_rate')}, {_r('sentiment_score')} FROM wk",
    "weekly_zscores": f"WITH {_RV}, {_weeks('rv')} SELECT product_name, week_no, {_r('z_avg_rating')}, {_r('z_complaint_rate')}, {_r('z_volume')} FROM wk",
    "weekly_anomalies": f"""WITH {_RV}, {_weeks('rv')},
a AS (SELECT product_name, week_no, 'RATING CRASH' AS type, z_avg_rating AS z, avg_rating AS metric, base_avg_rating AS baseline FROM wk WHERE z_avg_rating < -2 AND avg_rating < 4
UNION ALL SELECT product_name, week_no, 'COMPLAINT SPIKE', z_complaint_rate, complaint_rate, base_complaint_rate FROM wk WHERE NOT (z_avg_rating < -2 AND avg_rating < 4) AND z_complaint_rate > 2
UNION ALL SELECT product_name, week_no, 'VOLUME SPIKE with LOW RATING', z_volume, volume, base_volume FROM wk WHERE NOT (z_avg_rating < -2 AND avg_rating < 4) AND z_volume > 2 AND avg_rating < 3)
SELECT product_name, week_no, type, {_r('z')}, {_r('metric')}, {_r('baseline')} FROM a WHERE week_no >= 4""",
    "silent_growth": f"WITH {_RV}, {_weeks('rv')}, t AS (SELECT *, lag(z_complaint_rate, 1) OVER w AS z1, lag(z_complaint_rate, 2) OVER w AS z2 FROM wk WINDOW w AS (PARTITION BY product_name ORDER BY week_end)) SELECT product_name, week_no, {_r('z_complaint_rate')} FROM t WHERE z_complaint_rate > 0.5 AND z1 > 0.5 AND z2 > 0.5",
    "feature_heatmap": f"""WITH {_EV}, h0 AS (SELECT product_name, (date_trunc('week', ts - INTERVAL 1 DAY) + INTERVAL 7 DAY)::DATE AS week_end, count(rating) AS volume, {', '.join(f"count_if(feature_no = {k} AND rating <= 2) AS f{k}" for k in range(6))} FROM ev GROUP BY 1, 2),
h1 AS ({' UNION ALL '.join(f"SELECT product_name, week_end, 'F{k}' AS feature, f{k} / volume * 100::DOUBLE AS rate FROM h0" for k in range(6))}),
h2 AS (SELECT *, count(rate) OVER p AS n, avg(rate) OVER p AS m, stddev_samp(rate) OVER p AS sd FROM h1 WINDOW p AS (PARTITION BY product_name, feature ORDER BY week_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT product_name, week_end::VARCHAR AS week_end, feature, {_r('rate')}, {_r('CASE WHEN n >= 2 AND sd > 1e-9 THEN (rate - m) / sd ELSE 0 END', 4, 'z')} FROM h2""",
    "batch_time": f"WITH {_EV}, {_batches('floor(datediff(' + chr(39) + 'day' + chr(39) + ', d0, ts::DATE) / 7)', 'SELECT *, min(ts::DATE) OVER (PARTITION BY product_name) AS d0 FROM ev')} SELECT {_BATCH_COLS} FROM bt",
    "batch_fixed": f"WITH {_EV}, {_FIXED} SELECT {_BATCH_COLS} FROM bt",
    "degradation": f"""WITH {_EV}, {_FIXED}, g AS (SELECT *, round(avg_rating, 1) AS r, count(*) OVER (PARTITION BY product_name) AS batches FROM bt),
d AS (SELECT product_name, max(CASE WHEN batch_no = 1 THEN r END) AS first_rating, min(CASE WHEN batch_no >= 3 AND r < 5.0 THEN batch_no END)::INTEGER AS degraded_at, avg(CASE WHEN batch_no <= 2 THEN avg_rating END) AS early, avg(CASE WHEN batch_no > batches - 2 THEN avg_rating END) AS recent FROM g WHERE batches >= 3 GROUP BY 1)
SELECT product_name, {_r('first_rating', 1)}, degraded_at, {_r('early')}, {_r('recent')} FROM d WHERE first_rating > 1.0 AND degraded_at IS NOT NULL""",
    "kpi_overview": f"WITH {_EV} SELECT count(*) AS reviews, count(rating) AS rated, {_r('sum(rating) / count(rating)', 4, 'avg_rating')}, {_r('count_if(sentiment = ' + chr(39) + 'negative' + chr(39) + ') / count(*) * 100', 4, 'negative_pct')}, {_r('count_if(sentiment = ' + chr(39) + 'positive' + chr(39) + ') / count(*) * 100', 4, 'positive_pct')}, count(DISTINCT product_name) AS products FROM ev",
    "product_rating_alerts": f"WITH {_EV}, a AS (SELECT product_name, sum(rating) / count(rating) AS a FROM ev GROUP BY 1) SELECT product_name, {_r('a', 4, 'avg_rating')}, CASE WHEN a < 3 THEN 'CRITICAL' WHEN a < 3.5 THEN 'WARNING' ELSE 'OK' END AS alert FROM a",
    "product_sentiment": f"WITH {_EV} SELECT product_name, sentiment, count(*) AS reviews FROM ev GROUP BY 1, 2",
    "value_counts_lang": "SELECT lang AS language, count(*) AS reviews FROM documents GROUP BY 1",
    "distinct_products": "SELECT DISTINCT source AS product_name FROM documents",
    "unextracted_anti": f"WITH {_DOC} SELECT review_id, product_name FROM doc WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = review_id)",
    "features_inner": f"WITH {_DOC} SELECT product_name, count(*) AS labelled, sum(toxic)::BIGINT AS toxic, sum(quality)::BIGINT AS good FROM doc JOIN labels ON doc_id = review_id GROUP BY 1",
    "reviews_nested_features": f"WITH {_DOC}, t AS (SELECT conv_id, string_agg(turn || ':' || role, ',' ORDER BY turn, role) AS turns FROM conversations GROUP BY 1) SELECT review_id, coalesce(turns, '') AS turns FROM doc LEFT JOIN t ON review_id = conv_id",
    "bot_user_anti": f"WITH {_EV}, b AS (SELECT username FROM ev GROUP BY 1 HAVING count_if(sentiment = 'negative') * 4 > count(*)) SELECT product_name, count(*) AS reviews FROM ev WHERE username NOT IN (SELECT username FROM b) GROUP BY 1",
    "keyword_rates": f"""WITH {_DOC}, k AS (SELECT unnest(list_filter({_LIST(_KEY)}, lambda k: contains(lower(review_text), k))) AS keyword FROM doc), c AS (SELECT keyword, count(*) AS reviews, count(*) / (SELECT count(*) FROM doc) * 100::DOUBLE AS rate0 FROM k GROUP BY 1)
SELECT keyword, reviews, {_r('rate0', 4, 'rate')}, CASE WHEN rate0 > 25 THEN 'SYSTEMIC' WHEN rate0 > 15 THEN 'EMERGING' ELSE 'MONITOR' END AS status, floor(least(rate0 * 2.5, 100))::INTEGER AS score FROM c ORDER BY reviews DESC, keyword LIMIT 3""",
    "keyword_top_issue": f"""WITH {_DOC}, k AS (SELECT product_name, unnest(list_filter({_LIST(_KEY)}, lambda k: contains(lower(review_text), k))) AS keyword FROM doc), c AS (SELECT product_name, keyword, count(*) AS n FROM k GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY product_name ORDER BY n DESC, list_position({_LIST(_KEY)}, keyword)) AS r FROM c) SELECT product_name, upper(keyword[1]) || keyword[2:] AS top_word, n FROM t WHERE r = 1""",
    "keyword_extraction": f"""WITH {_DOC}, t AS (SELECT review_id, list_filter({_LIST(_KEY)}, lambda k: contains(lower(review_text), k)) AS f, len(list_filter({_LIST(_NEG)}, lambda k: contains(lower(review_text), k))) AS n, len(list_filter({_LIST(_POS)}, lambda k: contains(lower(review_text), k))) AS p FROM doc)
SELECT review_id, unnest(f) AS feature, CASE WHEN n > p THEN 'negative' WHEN p > n THEN 'positive' ELSE 'neutral' END AS sentiment FROM t""",
    "precision_recall": f"""WITH {_DOC}, {_quality('review_text', ['the', 'and', 'of', 'to', 'in'], ['is'])}, c AS (SELECT count_if(score < 100 AND quality = 0)::BIGINT AS tp, count_if(score < 100 AND quality <> 0)::BIGINT AS fp, count_if(score >= 100 AND quality = 0)::BIGINT AS fn FROM q JOIN labels ON doc_id = review_id)
SELECT tp, fp, fn, {_r('CASE WHEN tp + fp > 0 THEN tp / (tp + fp) * 100 ELSE 0 END', 1, 'precision')}, {_r('CASE WHEN tp + fn > 0 THEN tp / (tp + fn) * 100 ELSE 0 END', 1, 'recall')} FROM c""",
    "exact_dups": f"WITH {_DOC}, t AS (SELECT review_id, count(*) OVER (PARTITION BY {_NORM}) AS copies, min(review_id) OVER (PARTITION BY {_NORM}) AS first_id FROM doc WHERE length(trim(review_text)) > 0) SELECT review_id, copies, first_id, review_id <> first_id AS is_duplicate FROM t WHERE copies > 1",
    "template_dups": f"WITH {_DOC}, {_TEMPLATE} SELECT review_id, matches FROM tp WHERE matches >= 3",
    "repetitive_sentences": f"WITH {_DOC}, {_SENT} SELECT review_id FROM rep WHERE repetitive",
    "tfidf_edges": f"WITH {_TFIDF} SELECT a, b, {_r('similarity')} FROM edge",
    "dup_components": f"WITH RECURSIVE {_GROUPS} SELECT review_id, group_id, group_size FROM grp",
    "trust_scores": f"WITH RECURSIVE {_TRUST} SELECT review_id, group_id, trust_score, trust_score < 30 OR flagged AS is_suspicious FROM tr",
    "dedup_stats": f"WITH RECURSIVE {_TRUST} SELECT count(*) AS reviews, count_if(trust_score < 30 OR flagged)::BIGINT AS suspicious, count_if(trust_score >= 90)::BIGINT AS trusted, count_if(trust_score >= 70 AND trust_score < 90)::BIGINT AS minor, count_if(trust_score >= 40 AND trust_score < 70)::BIGINT AS questionable, count_if(trust_score < 40)::BIGINT AS bots, count(DISTINCT group_id) AS groups, (SELECT max(c) FROM (SELECT count(*) AS c FROM tr WHERE group_id IS NOT NULL GROUP BY group_id)) AS largest_group FROM tr",
    "bot_scores": f"""WITH {_DOC}, b0 AS (SELECT review_id, review_id % 5 + 1 AS rating, review_id % 3 = 0 AS named, regexp_extract_all(lower(review_text), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM doc),
b1 AS (SELECT review_id, list_filter([CASE WHEN (rating >= 4 AND {_W('ws', S.BOT_NEGATIVE)} > 3) OR (rating <= 2 AND {_W('ws', S.BOT_POSITIVE)} > 3) THEN 'RATING_SENTIMENT_MISMATCH:20' END,
 CASE WHEN len(ws) > 0 AND len(list_distinct(ws)) / len(ws) < 0.4 THEN 'LOW_LEXICAL_DIVERSITY:20' END, CASE WHEN len(ws) > 0 AND len(list_distinct(ws)) / len(ws) BETWEEN 0.4 AND 0.6 THEN 'SUSPICIOUS_LEXICAL_DIVERSITY:10' END,
 CASE WHEN len(ws) < 5 THEN 'TOO_SHORT:15' END, CASE WHEN len(ws) >= 5 AND {_W('ws', S.BOT_GENERIC)} >= 5 AND {_W('ws', S.BOT_SPECIFIC)} = 0 THEN 'GENERIC_PRAISE:20' END, CASE WHEN named THEN 'AUTO_GENERATED_USERNAME:15' END], lambda x: x IS NOT NULL) AS s FROM b0),
b2 AS (SELECT review_id, coalesce(list_sum(list_transform(s, lambda x: string_split(x, ':')[2]::INTEGER)), 0)::INTEGER AS bot_score, array_to_string(list_transform(s, lambda x: string_split(x, ':')[1]), ',') AS signals FROM b1)
SELECT review_id, bot_score, CASE WHEN bot_score <= 25 THEN 'TRUSTED' WHEN bot_score <= 50 THEN 'LOW_SUSPICION' WHEN bot_score <= 75 THEN 'HIGH_SUSPICION' ELSE 'CONFIRMED_BOT' END AS status, signals FROM b2""",
    "burst_candidates": f"""WITH {_EV}, s AS (SELECT *, epoch(date_trunc('second', ts))::BIGINT AS sec FROM ev), b AS (SELECT review_id, product_name, count(*) OVER w AS in_window, min(rating) OVER w AS lo, max(rating) OVER w AS hi FROM s WINDOW w AS (PARTITION BY product_name ORDER BY sec RANGE BETWEEN CURRENT ROW AND 7200 FOLLOWING))
SELECT review_id, product_name, in_window, lo AS campaign_rating FROM b WHERE in_window >= 3 AND lo = hi AND lo IN (1, 5)""",
    "burst_campaigns": f"WITH RECURSIVE {_EV}, {_BURSTS} SELECT * FROM gb",
    "sequential_users": f"""WITH {_EV}, u AS (SELECT DISTINCT 'user_' AS prefix, user_id AS number FROM ev WHERE rating = 1), i AS (SELECT *, coalesce((number - lag(number) OVER (ORDER BY number) > 2)::INTEGER, 0) AS new FROM u), g AS (SELECT *, sum(new) OVER (ORDER BY number) AS island FROM i)
SELECT prefix, island::BIGINT AS island, min(number) AS low, max(number) AS high, count(*) AS users FROM g GROUP BY 1, 2 HAVING count(*) >= 3""",
    "emotion_scores": f"WITH {_DOC}, {_EMOTION} SELECT review_id, emotion, confidence, urgency, raw_score FROM em",
    "emotion_distribution": f"WITH {_DOC}, {_EMOTION}, n(emotion) AS (VALUES {', '.join(f'''('{e[0]}')''' for e in _EMO)}) SELECT n.emotion, count(review_id) AS reviews FROM n LEFT JOIN em ON n.emotion = em.emotion GROUP BY 1",
    "emotion_timeline": f"WITH {_DOC}, {_EMOTION} SELECT (review_id // 100 + 1)::BIGINT AS window_no, {', '.join(f'''count_if(emotion = '{e[0]}')::BIGINT AS {e[0]}''' for e in _EMO)} FROM em GROUP BY 1",
    "sarcasm_pass1": f"WITH {_DOC}, s AS (SELECT review_id, list_filter([{_SARC}], lambda x: x IS NOT NULL) AS f FROM doc) SELECT review_id, array_to_string(f, ',') AS flags, least(0.7, {' + '.join(f'''CASE WHEN list_contains(f, '{n}') THEN {w} ELSE 0 END''' for n, _, w in S.SARCASM_RULES)})::DOUBLE AS confidence FROM s",
    "local_sentiment": f"""WITH {_DOC}, t AS (SELECT review_id, CASE WHEN review_id % 4 = 0 THEN review_id % 5 + 1 END AS rating, len(list_filter({_LIST(_NEG)}, lambda k: contains(lower(review_text), k))) AS n, len(list_filter({_LIST(_POS)}, lambda k: contains(lower(review_text), k))) AS p FROM doc)
SELECT review_id, CASE WHEN rating >= 4 THEN 'positive' WHEN rating <= 2 THEN 'negative' WHEN rating IS NOT NULL THEN 'neutral' WHEN n > p THEN 'negative' WHEN p > n THEN 'positive' ELSE 'neutral' END AS sentiment FROM t""",
    "quality_score": f"WITH {_DOC}, {_Q1} SELECT review_id, score FROM q",
    "quality_histogram": f"WITH {_DOC}, {_Q1} SELECT (score // 5)::BIGINT AS bin, count(*) AS reviews FROM q GROUP BY 1",
    "vocab_emerging": f"""WITH {_DOC}, v0 AS (SELECT review_id, review_id > (SELECT max(review_id) / 2 FROM doc) AS cur, regexp_extract_all(lower(review_text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM doc), v1 AS (SELECT DISTINCT review_id, cur, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM v0 WHERE len(w) > 1),
v AS (SELECT phrase, count_if(cur)::BIGINT AS current, count_if(NOT cur)::BIGINT AS baseline FROM v1 GROUP BY 1) SELECT phrase, current, baseline, current - baseline AS score FROM v WHERE current >= 5 AND baseline < 2""",
    "revenue_scenarios": f"""WITH {_EV}, p AS (SELECT product_name, sum(rating) / count(rating) AS rating, count_if(sentiment = 'negative') / count(*) * 100::DOUBLE AS rate, sum(value) AS revenue FROM ev GROUP BY 1),
s AS (SELECT *, 'do_nothing' AS scenario, rate - 8.0::DOUBLE AS change FROM p UNION ALL SELECT *, 'partial_fix', (rate - 8.0::DOUBLE) * 0.4::DOUBLE FROM p UNION ALL SELECT *, 'full_fix', (rate - 8.0::DOUBLE) * 0.1::DOUBLE - 2 FROM p),
n AS (SELECT *, greatest(1, least(5, round(rating - change * 0.08::DOUBLE, 1)))::DOUBLE AS new_rating FROM s)
SELECT product_name, scenario, new_rating, {_r('CASE WHEN rating - new_rating > 0 THEN -(rating - new_rating) * 0.12 * revenue ELSE abs(rating - new_rating) * 0.12 * revenue * 0.5 END', 0, 'revenue_impact')} FROM n""",
    "crisis_inject": """WITH c AS (SELECT count(*) AS n0, count_if(doc_id % 8 = 0) AS b0 FROM documents), r AS (SELECT b0 / n0 * 100::DOUBLE AS b, (b0 + 50) / (n0 + 50) * 100::DOUBLE AS a FROM c)
SELECT round(b, 4) AS before, round(a, 4) AS after, round(CASE WHEN b = 0 THEN 4 ELSE (a - b) / greatest(b * 0.3, 1) END, 4)::DOUBLE AS z, round(-(a - b) * 0.08, 4)::DOUBLE AS rating_impact, round(abs((a - b) * 0.08) * 0.12 * 500000, 0)::DOUBLE AS revenue_at_risk FROM r""",
    "reply_queue": f"WITH {_EV} SELECT review_id, product_name, (CASE WHEN value > 300 THEN 0.9 WHEN value > 100 THEN 0.6 ELSE 0.3 END)::DOUBLE AS urgency, 'Support' AS team FROM ev WHERE sentiment = 'negative' ORDER BY urgency DESC, review_id LIMIT 20",
    "paste_parse": """WITH l AS (SELECT conv_id, turn, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: length(x) > 0)[1:20] AS ls FROM conversations), e AS (SELECT conv_id, turn, unnest(range(1, len(ls) + 1)) AS position, unnest(ls) AS review_text FROM l)
SELECT conv_id, turn, position::INTEGER AS position, review_text FROM e WHERE length(review_text) > 10""",
    "cross_product": f"WITH {_RV}, t AS (SELECT feature, product_name, count_if(sentiment = 'negative') / count(*) AS r FROM rv GROUP BY 1, 2) SELECT feature, count(*) AS products FROM t WHERE r >= 0.33 GROUP BY 1 HAVING count(*) >= 2",
    "product_feature_heatmap": f"WITH {_RV} SELECT product_name, feature, count(*) AS mentions, CASE WHEN count(*) >= 5 THEN round(count_if(sentiment = 'negative') / count(*) * 100::DOUBLE, 4) + 0.0::DOUBLE END AS complaint_rate FROM rv GROUP BY 1, 2",
    "stream_weekly": "SELECT date_trunc('week', ts)::DATE::VARCHAR AS week, event_type, count(*) AS events FROM events GROUP BY 1, 2",
}


def _squeezed() -> str:
    """RE2 has no back-references: one replacement for each letter and mark."""
    text = "html"
    for mark in "!?.":
        text = f"regexp_replace({text}, '[{mark}]{{2,}}', '{mark}', 'g')"
    for letter in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
        text = f"regexp_replace({text}, '{letter}{{3,}}', '{letter}{letter}', 'g')"
    return f"SELECT page_id, trim(regexp_replace(regexp_replace({text}, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS clean_text FROM pages"


SQL["text_normalize"] = _squeezed()


def _phrases() -> str:
    empty = _LIST([*S.PHRASE_STOP_WORDS, *S.PHRASE_PRODUCT_WORDS])
    runs = lambda n: f"list_transform(range(1, len(w) - {n} + 2), lambda i: w[i:i + {n} - 1])"
    return f"""{_DOC},
p0 AS (SELECT review_id, review_id > (SELECT max(review_id) / 2 FROM doc) AS cur, list_filter(regexp_extract_all(lower(coalesce(review_text, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda x: NOT list_contains({_LIST(S.PHRASE_STOP_WORDS)}, x)) AS w FROM doc),
p1 AS (SELECT DISTINCT review_id, cur, unnest(list_concat(list_concat({runs(2)}, {runs(3)}), {runs(4)})) AS p FROM p0),
p2 AS (SELECT review_id, cur, array_to_string(p, ' ') AS phrase FROM p1 WHERE len(list_filter(p, lambda x: NOT list_contains({empty}, x))) > 0 AND len(list_filter(p, lambda x: NOT regexp_full_match(x, '[0-9]+'))) > 0 AND len(list_filter(p, lambda x: length(x) > 2)) > 0),
fq AS (SELECT phrase, count_if(cur)::BIGINT AS current, count_if(NOT cur)::BIGINT AS baseline FROM p2 GROUP BY 1),
eg AS (SELECT *, current - baseline AS emergence_score FROM fq WHERE current >= 3 AND baseline < 2)"""


def _replies() -> str:
    values = ", ".join("('{}', '{}', '{}')".format(t, c, x.replace("'", "''")) for t, texts in S.REPLIES.items() for c, x in texts.items())
    return f"""WITH {_DOC}, i AS (SELECT review_id, product_name, ['Seal', 'build', 'transit', 'price'][(review_id % 4 + 1)::INTEGER] AS feature, ['packaging', 'quality', 'delivery', 'default'][(review_id % 4 + 1)::INTEGER] AS category, ['packaging team', 'quality team', 'logistics team', 'support team'][(review_id % 4 + 1)::INTEGER] AS team FROM doc),
t(tone, category, body) AS (VALUES {values}), r AS (SELECT review_id, i.category, tone, replace(replace(replace(replace(body, '{{product}}', coalesce(product_name, '')), '{{issue}}', feature), '{{ref_id}}', 'REF-' || review_id), '{{team}}', team) AS response_text FROM i JOIN t ON i.category = t.category)
SELECT *, len(regexp_split_to_array(trim(response_text), '\\s+'))::INTEGER AS word_count FROM r"""


_ISLANDS = f"""{_EV}, u AS (SELECT DISTINCT 'user_' AS prefix, user_id AS number FROM ev WHERE rating = 1), i AS (SELECT *, coalesce((number - lag(number) OVER (ORDER BY number) > 2)::INTEGER, 0) AS new FROM u), g AS (SELECT *, sum(new) OVER (ORDER BY number) AS island FROM i),
mb AS (SELECT *, prefix || number AS username, count(*) OVER (PARTITION BY island) AS n FROM g), mm AS (SELECT * FROM mb WHERE n >= 3)"""
_TEXT_GROUPS = f"{_tfidf(_UNIGRAMS, '> 0.65', _TOP_TERMS)},{_COMPONENTS}"
_HINDI, _ENGLISH = (f"len(list_filter(ws, lambda x: list_contains({_LIST(xs)}, x)))" for xs in (S.HINDI_WORDS, S.ENGLISH_WORDS))
_EXPANDED = "concat_ws(' ', 'Gr8 pls', text, 'bcz bahut mast')"
for _short, _long in S.ABBREVIATIONS.items():
    _EXPANDED = f"regexp_replace({_EXPANDED}, '(?i)\\b{_short}\\b', '{_long}', 'g')"

SQL |= {
    "phrase_frequency": f"WITH {_phrases()} SELECT * FROM fq WHERE current + baseline >= 3",
    "phrase_emerging": f"WITH {_phrases()} SELECT * FROM eg",
    "phrase_novel": f"WITH {_phrases()} SELECT phrase, emergence_score FROM eg WHERE len(list_filter({_LIST(_KEY[:5])}, lambda t: contains(phrase, t) OR contains(t, phrase))) = 0",
    "vocabulary_alert": f"""WITH {_phrases()}, s AS (SELECT phrase, emergence_score, row_number() OVER (ORDER BY emergence_score DESC, phrase) AS r FROM eg WHERE emergence_score >= 3)
SELECT 'all' AS product_name, 'W2' AS "window", CASE WHEN count(*) >= 3 THEN 'high' ELSE 'medium' END AS severity, count(*) AS significant, string_agg(phrase, ',' ORDER BY r) FILTER (r <= 5) AS suggested FROM s HAVING count(*) > 0""",
    "text_campaigns": f"WITH RECURSIVE {_TEXT_GROUPS} SELECT 'TEXT_SIMILARITY' AS kind, group_id::VARCHAR AS campaign_id, count(*) AS members, 60::INTEGER AS confidence, 'SUSPICIOUS CLUSTER' AS label, 3.0::DOUBLE AS avg_rating, count(*) || ' functionally identical reviews found.' AS summary FROM grp GROUP BY group_id HAVING count(*) >= 3",
    "username_campaigns": f"WITH {_ISLANDS} SELECT 'USERNAME_PATTERN' AS kind, 'user_' || min(number) AS campaign_id, count(*) AS members, 75::INTEGER AS confidence, 'HIGH PROBABILITY COORDINATED ATTACK' AS label, 3.0::DOUBLE AS avg_rating, count(*) || ' sequential usernames detected.' AS summary FROM mm GROUP BY island",
    "campaign_union": f"""WITH RECURSIVE {_TEXT_GROUPS}, {_ISLANDS}, {_BURSTS}
SELECT 'TEXT_SIMILARITY' AS kind, group_id::VARCHAR AS campaign_id, count(*) AS members, 60::INTEGER AS confidence, 'SUSPICIOUS CLUSTER' AS label, 3.0::DOUBLE AS avg_rating, count(*) || ' functionally identical reviews found.' AS summary FROM grp GROUP BY group_id HAVING count(*) >= 3
UNION ALL SELECT 'USERNAME_PATTERN', 'user_' || min(number), count(*), 75, 'HIGH PROBABILITY COORDINATED ATTACK', 3.0, count(*) || ' sequential usernames detected.' FROM mm GROUP BY island
UNION ALL SELECT 'TIMESTAMP_BURST', campaign_id::VARCHAR, count(*), 75, 'HIGH PROBABILITY COORDINATED ATTACK', min(rating)::DOUBLE, count(*) || ' reviews submitted identically within 2 hours.' FROM gb GROUP BY product_name, campaign_id""",
    "network_nodes": f"""WITH {_ISLANDS}, o AS (SELECT username, count_if(rating = 1) * 10 AS s FROM ev GROUP BY 1)
SELECT username, left(username, 15) AS label, '{S.CAMPAIGN_COLOR}' AS color, 25::INTEGER AS size FROM mm UNION ALL
SELECT username, left(username, 15), CASE WHEN s <= 25 THEN '#4CAF50' WHEN s <= 50 THEN '#FFEB3B' WHEN s <= 75 THEN '#FF9800' ELSE '#F44336' END, 15::INTEGER FROM o WHERE username NOT IN (SELECT username FROM mm)""",
    "network_edges": f"WITH {_ISLANDS}, h AS (SELECT island, min(username) AS hub FROM mm GROUP BY 1) SELECT hub AS from_user, username AS to_user FROM mm JOIN h USING (island) WHERE username <> hub",
    "bot_exact_copies": f"WITH {_DOC} SELECT md5(replace(lower(review_text), ' ', '')) AS text_key, min(review_id) AS kept_id, count(*) - 1 AS removed FROM doc GROUP BY 1 HAVING count(*) > 1",
    "reply_drafts": _replies(),
    "surprise_sentiments": f"WITH {_EV} SELECT n.s AS sentiment, count(ev.sentiment) AS reviews FROM (VALUES ('positive'), ('negative'), ('neutral'), ('mixed')) AS n(s) LEFT JOIN ev ON ev.sentiment = n.s GROUP BY 1",
    "surprise_issues": f"WITH {_RV} SELECT feature, count(*) AS complaints, {_r('avg(coalesce(intensity, 0.5))', 4, 'avg_intensity')} FROM rv WHERE sentiment = 'negative' GROUP BY 1 ORDER BY complaints DESC, feature LIMIT 5",
    "review_language": f"""WITH {_DOC}, t AS (SELECT review_id, coalesce(review_text, '') AS x, regexp_extract_all(lower(coalesce(review_text, '')), '[a-z]+') AS ws FROM doc)
SELECT review_id, CASE WHEN regexp_matches(x, '[\\x{{900}}-\\x{{D7F}}]') THEN 'HI' WHEN len(ws) = 0 THEN 'OTHER' WHEN {_HINDI} / len(ws) > 0.2 THEN 'HINGLISH' WHEN {_ENGLISH} / len(ws) >= 0.1 THEN 'EN' ELSE 'OTHER' END AS language FROM t""",
    # the tables hold no text to unscramble; fixtures test that
    "text_repair": f"WITH {_DOC} SELECT review_id, md5(translate(replace(nfc_normalize(review_text), chr(0), ''), '‘’“”​‌‍﻿᠎', '''''\"\"')) AS repaired_md5 FROM doc",
    "abbreviation_expand": f"SELECT conv_id, turn, role, {_EXPANDED} AS text FROM conversations",
    "emotion_urgency": f"WITH {_DOC}, {_EMOTION} SELECT urgency, count(*) AS reviews, min(review_id) AS first_id FROM em GROUP BY 1",
    "window_status": f"WITH {_RATES} SELECT product_name, CASE WHEN complaint_rate > 30 THEN 'ALERT' WHEN complaint_rate >= 25 THEN 'WATCH' ELSE 'OK' END AS status, count(*) AS windows FROM rates GROUP BY 1, 2",
    "executive_summary": f"""WITH {_ISSUES}, t AS (SELECT *, row_number() OVER (PARTITION BY product_name ORDER BY priority DESC, feature) AS r FROM lv)
SELECT product_name, count(*) || ' issues (' || count_if(level = 'critical') || ' critical, ' || count_if(level = 'high') || ' high); top: ' || max(CASE WHEN r = 1 THEN feature END) AS summary FROM t GROUP BY 1""",
}
