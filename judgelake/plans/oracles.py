"""SQL over the plain tables for each query that SQL can express, written apart from the operators."""

from __future__ import annotations

import math
import re

from judgelake.fixtures import VIEWS, ctes
from judgelake.functions import text as T

_RULES = " ".join(f"WHEN contains(error_type, '{word}') THEN '{label}'" for word, label in T.ERROR_RULES)
ERROR_LABEL = f"CASE WHEN coalesce(error_type, '') = '' THEN '{T.UNCLASSIFIED}' {_RULES} ELSE error_type END"
_PUNCTUATION = T.PUNCTUATION.replace("'", "''")


def _normal(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[\\s\\p{{Z}}]+', '', 'g'), '{_PUNCTUATION}', '', 'g')"


def _strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+\\z', '', 'g')"


def _bigrams(x: str) -> str:
    plain = f"regexp_replace(coalesce({x}, ''), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', '', 'g')"
    return f"list_filter(list_transform(range(1, length({plain})), lambda k: substring({plain}, k, 2)), lambda g: NOT regexp_matches(g, '[{T.STOP_CHARACTERS}]'))"


_LABELS = """WITH said AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_name || ' by ' || p_brand END AS said FROM part),
names_ AS (SELECT word, max(skill) AS skill FROM (
    SELECT lower(p_brand) AS skill, lower(p_brand) AS word FROM part UNION ALL SELECT lower(p_brand), p_brand FROM part
    UNION ALL SELECT upper(p_name), upper(p_name) FROM part UNION ALL SELECT upper(p_name), split_part(p_name, ' ', 2) FROM part) a WHERE word <> '' GROUP BY word)
SELECT s.id, arg_max(skill, {'e': CAST(said = word AS INT), 'n': length(word), 's': skill}) AS label
FROM said s LEFT JOIN names_ ON contains(said, word) AND NOT contains(said, 'red') GROUP BY s.id"""


def _bootstrap(by: str, rows: str) -> str:
    """Poisson weights from 16 bits of a digest of vote and block of eight resamples: as many as there are cumulative chances not above."""
    least = ", ".join(str(int(65536 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)))) for k in range(8))
    draw = "len(list_filter([" + least + "], lambda c: c <= CAST('0x' || substring(md5(vote_id || ':' || r // 8), 4 * (r % 8) + 1, 4) AS INT)))"
    return f"""SELECT {by}, max(n) AS n, round(CASE WHEN max(n) > 1 THEN quantile_cont(mean, 0.025) END, 6) AS low, round(CASE WHEN max(n) > 1 THEN quantile_cont(mean, 0.975) END, 6) AS high
FROM (SELECT {by}, r, count(*) AS n, sum(k * x) / nullif(sum(k), 0) AS mean FROM (
    SELECT {by}, r, {draw} AS k, CASE w WHEN 'a' THEN 1.0 WHEN 'tie' THEN 0.5 ELSE 0.0 END AS x FROM {rows} v, (SELECT unnest(range(200)) AS r) u WHERE w IN ('a', 'b', 'tie')) a GROUP BY {by}, r) b GROUP BY {by}"""


_TAILS = """WITH keyed AS (
    SELECT user_id AS item_id, epoch_us(ts) AS updated_at, event_type AS module, 'e' || event_id AS message, CASE WHEN event_type = 'signup' THEN value END AS started,
           CASE WHEN event_id % 3 > 0 THEN 'seq:' || event_id
                ELSE concat_ws('|', epoch_us(ts), event_type, 'e' || event_id, CASE WHEN event_id % 2 = 0 THEN 'j1' ELSE '' END, event_id % 4, 'said') END AS key,
           CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 END AS rank
    FROM events
), extremes AS (
    SELECT item_id, max(rank) AS stage, arg_max(started, {'a': updated_at, 'k': key}) FILTER (WHERE started IS NOT NULL) AS started_at FROM keyed GROUP BY item_id
)
SELECT k.item_id, key, updated_at, module, message, round(started_at, 6) AS started_at, stage
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY updated_at DESC, key DESC) AS rn FROM keyed) k JOIN extremes s ON k.item_id = s.item_id WHERE rn <= 50"""

#: Named steps: the views they read and their SQL.
STEPS: dict[str, str] = {
    "dim_ranked": "SELECT item_id, model, dim, score, row_number() OVER w AS rn, count(*) OVER (PARTITION BY item_id, model, dim) AS n FROM vote_dims WHERE score IS NOT NULL WINDOW w AS (PARTITION BY item_id, model, dim ORDER BY score)",
    "dim_trimmed": "SELECT item_id, model, dim, avg(score) AS mean_score FROM dim_ranked WHERE n <= 2 OR (rn > floor(n * 0.1) AND rn <= n - floor(n * 0.1)) GROUP BY item_id, model, dim",
    "dims": "SELECT v.item_id, v.model, v.dim, m.mean_score, v.is_na FROM (SELECT item_id, model, dim, bool_and(is_na) AS is_na FROM vote_dims GROUP BY item_id, model, dim) v LEFT JOIN dim_trimmed m ON v.item_id = m.item_id AND v.model = m.model AND v.dim = m.dim",
    "weights": "SELECT DISTINCT dim, weight FROM vote_dims",
    "totals": "SELECT d.item_id, d.model, coalesce(sum(mean_score * weight) / sum(weight), 0.0) AS total FROM dims d JOIN weights w ON d.dim = w.dim WHERE NOT is_na AND mean_score IS NOT NULL GROUP BY d.item_id, d.model",
    "labels_": "SELECT item_id, model, CASE WHEN count(*) FILTER (WHERE c = top) = 1 THEN max(correctness) FILTER (WHERE c = top) ELSE 'unclear' END AS correctness, max(c) / CAST(sum(c) AS DOUBLE) AS agreement FROM (SELECT *, max(c) OVER (PARTITION BY item_id, model) AS top FROM (SELECT item_id, model, correctness, count(*) AS c FROM votes GROUP BY item_id, model, correctness) a) b GROUP BY item_id, model",
    "errors_": "SELECT item_id, model, CASE WHEN count(*) FILTER (WHERE c = top) = 1 THEN max(error_type) FILTER (WHERE c = top) END AS error_type FROM (SELECT *, max(c) OVER (PARTITION BY item_id, model) AS top FROM (SELECT item_id, model, error_type, count(*) AS c FROM votes WHERE error_type IS NOT NULL GROUP BY item_id, model, error_type) a) b GROUP BY item_id, model",
    "judges_": "SELECT item_id, model, count(*) AS n_judges, coalesce(avg(CASE WHEN runs > 1 THEN std END), 0.0) AS repeat_std FROM (SELECT item_id, model, judge, count(*) AS runs, stddev_pop(total) AS std FROM votes GROUP BY item_id, model, judge) a GROUP BY item_id, model",
    "verdicts": "SELECT l.item_id, l.model, coalesce(t.total, 0.0) AS total, l.correctness, e.error_type, l.agreement, j.repeat_std, j.n_judges, l.agreement < CAST(0.6 AS DOUBLE) OR round(j.repeat_std, 9) > CAST(1.05 AS DOUBLE) AS low_agreement FROM labels_ l JOIN judges_ j ON l.item_id = j.item_id AND l.model = j.model LEFT JOIN errors_ e ON l.item_id = e.item_id AND l.model = e.model LEFT JOIN totals t ON l.item_id = t.item_id AND l.model = t.model",
    "pv": "SELECT *, CASE WHEN pres_order = 'ba' AND raw_winner = 'a' THEN 'b' WHEN pres_order = 'ba' AND raw_winner = 'b' THEN 'a' ELSE raw_winner END AS w FROM pair_votes",
    "sides": "SELECT item_id, model_a, model_b, pres_order, CASE WHEN count(*) FILTER (WHERE c = top) = 1 THEN max(w) FILTER (WHERE c = top) END AS best FROM (SELECT *, max(c) OVER (PARTITION BY item_id, model_a, model_b, pres_order) AS top FROM (SELECT item_id, model_a, model_b, pres_order, w, count(*) AS c FROM pv GROUP BY ALL) a) b GROUP BY item_id, model_a, model_b, pres_order",
    "sums": "SELECT item_id, model_a, model_b, count(*) FILTER (WHERE w = 'a') AS a_wins, count(*) FILTER (WHERE w = 'b') AS b_wins, count(*) FILTER (WHERE w = 'tie') AS ties FROM pv GROUP BY item_id, model_a, model_b",
    "pairs": "SELECT s.item_id, s.model_a, s.model_b, a_wins, b_wins, ties, CASE WHEN a_wins > b_wins THEN 'a' WHEN b_wins > a_wins THEN 'b' ELSE 'tie' END AS winner, (a_wins + 0.5 * ties) / CAST(a_wins + b_wins + ties AS DOUBLE) AS win_rate_a, greatest(a_wins, b_wins, ties) / CAST(a_wins + b_wins + ties AS DOUBLE) AS agreement, coalesce(x.best = y.best, true) AS consistent FROM sums s LEFT JOIN (SELECT * FROM sides WHERE pres_order = 'ab') x ON s.item_id = x.item_id AND s.model_b = x.model_b LEFT JOIN (SELECT * FROM sides WHERE pres_order = 'ba') y ON s.item_id = y.item_id AND s.model_b = y.model_b",
    "pair_results": "SELECT *, agreement < CAST(0.6 AS DOUBLE) OR NOT consistent AS low_agreement FROM pairs",
    "normal": f"SELECT item_id, {_normal('answer')} AS p, {_normal('reference')} AS r FROM qa WHERE reference <> ''",
    "scored": "SELECT item_id, CASE WHEN p = r THEN 1.0 ELSE 0.0 END AS em, CASE WHEN p = '' OR r = '' THEN 0.0 ELSE 2.0 * coalesce(list_sum(list_transform(list_distinct(string_split(p, '')), lambda c: least(length(p) - length(replace(p, c, '')), length(r) - length(replace(r, c, ''))))), 0) / (length(p) + length(r)) END AS f1 FROM normal",
    "truth": "SELECT *, CASE WHEN em = 1.0 OR f1 >= 0.85 THEN 'right' WHEN f1 >= 0.4 THEN 'partial' ELSE 'wrong' END AS objective FROM scored",
    "metas": "SELECT t.item_id, v.model, em, f1, objective, v.correctness AS judged, v.total AS judge_total, CASE WHEN v.correctness <> 'unclear' THEN v.correctness = objective END AS agree, v.total / 5 - f1 AS delta FROM truth t JOIN verdicts v ON t.item_id = v.item_id",
    "routed": "SELECT i.item_id, coalesce(arg_min(s.skill, s.load_ord), 'default') AS skill, coalesce(arg_min(s.display, s.load_ord), '通用') AS display FROM items i LEFT JOIN (SELECT * FROM skills UNION SELECT skill, display, load_ord, skill FROM skills) s ON i.category = s.category GROUP BY i.item_id",
    "frames": "SELECT user_id AS video_id, CAST(event_id AS DOUBLE) AS t, (event_id % 4) / 40.0 AS s0, (event_id // 50) % 2 / 2.0 AS s1 FROM events",
    "frame_runs": "SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY t) AS run FROM (SELECT *, CASE WHEN sqrt(((s0 - lag(s0) OVER w) ** 2 + (s1 - lag(s1) OVER w) ** 2) / 2) >= 0.065 THEN 1 ELSE 0 END AS new FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY t)) a",
    "run_table": "SELECT video_id, CAST(run AS BIGINT) AS run, min(t) AS \"start\", max(t) AS \"end\", count(*) AS frames, arg_min(s0, t) AS s0, arg_min(s1, t) AS s1 FROM frame_runs GROUP BY video_id, run",
    "stable": "SELECT video_id, run, \"start\", \"end\", frames, \"end\" - \"start\" <= 4.0 AND coalesce(sqrt(((lag(s0) OVER w - lead(s0) OVER w) ** 2 + (lag(s1) OVER w - lead(s1) OVER w) ** 2) / 2) < 0.065, false) AS transient FROM run_table WINDOW w AS (PARTITION BY video_id ORDER BY run)",
    "doc_chars": "SELECT lang, doc_id, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM (SELECT lang, doc_id, string_split(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}\\p{M}]+', '', 'g'), '') AS cs FROM documents) a",
    "doc_pairs": "SELECT lang, doc_id, c || lead(c) OVER (PARTITION BY doc_id ORDER BY i) AS keyword FROM doc_chars",
    "doc_grams": f"SELECT * FROM doc_pairs WHERE NOT regexp_matches(keyword, '[{T.STOP_CHARACTERS}]')",
    "bad": f"SELECT v.item_id, v.model, v.error_type, {ERROR_LABEL} AS error_label FROM verdicts v WHERE model = 'm0' AND correctness IN ('wrong', 'partial')",
    "clustered": "SELECT r.skill, b.error_label, b.item_id, i.question FROM bad b JOIN routed r ON b.item_id = r.item_id JOIN items i ON b.item_id = i.item_id",
    "grams": f"SELECT skill, error_label, item_id, unnest({_bigrams('question')}) AS keyword FROM clustered",
    "top_grams": "SELECT skill, error_label, keyword, count(*) AS texts FROM (SELECT *, row_number() OVER (PARTITION BY skill, error_label, item_id ORDER BY n DESC, keyword) AS rn FROM (SELECT skill, error_label, item_id, keyword, count(*) AS n FROM grams GROUP BY ALL) a) b WHERE rn <= 4 GROUP BY skill, error_label, keyword",
    "words": "SELECT skill, error_label, string_agg(keyword, ' ' ORDER BY rank) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY skill, error_label ORDER BY texts DESC, keyword) AS rank FROM top_grams) a WHERE rank <= 5 GROUP BY skill, error_label",
}


def oracle(select: str) -> str:
    """The SELECT behind a WITH clause of the views and steps that it needs, in order."""
    needed: list[str] = []

    def need(sql: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql)):
            if word in STEPS and word not in needed:
                need(STEPS[word])
                needed.append(word)
            elif word in VIEWS and word not in needed:
                needed.append(word)

    need(select)
    parts = [ctes(n) if n in VIEWS and n not in STEPS else f"{n} AS ({STEPS[n]})" for n in needed]
    return f"WITH {', '.join(parts)}\n{select}" if parts else select


def _measures(p: str = "") -> str:
    labels = ", ".join(f"count(*) FILTER (WHERE {p}correctness = '{c}') AS {c}_n" for c in ("right", "partial", "wrong", "unclear"))
    return f"count(*) AS n, round(avg({p}total), 6) AS mean_total, round(avg({p}total) / 5, 6) AS norm_mean, {labels}, round(avg(CAST(CAST({p}low_agreement AS INT) AS DOUBLE)), 6) AS low_rate"


_META = "count(*) AS n, round(avg(CAST(CAST(agree AS INT) AS DOUBLE)), 6) AS accuracy, round(avg(delta), 6) AS mean_delta, round(CASE WHEN count(*) >= 3 AND stddev_pop(judge_total) * stddev_pop(f1) > 0 THEN covar_pop(judge_total, f1) / (stddev_pop(judge_total) * stddev_pop(f1)) END, 6) AS pearson"
_RATE = "sum(a_wins + 0.5 * ties) / CAST(sum(a_wins + b_wins + ties) AS DOUBLE)"
_IDS = "SELECT {g}, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT {g}, item_id, dense_rank() OVER (PARTITION BY {g} ORDER BY item_id) AS rn FROM {t}) a WHERE rn <= 10 GROUP BY {g}"
_HTML = r"substring(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?i)<(script|style)[\s\S]*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')), 1, 2000)"
_PROMPT_CONTEXT = _strip("CASE WHEN item_id % 3 = 0 THEN answer END")
_PROMPT = f"CASE WHEN {_PROMPT_CONTEXT} = '' THEN {_strip('question')} ELSE {_strip(f'''('Context:' || chr(10) || {_PROMPT_CONTEXT} || chr(10) || chr(10) || 'Question:' || chr(10) || {_strip('question')})''')} END"
_VALID = "o_orderkey % 13 <> 0"

SELECTS = {
    "verdict_dims": "SELECT item_id, model, dim, round(mean_score, 6) AS mean_score, is_na FROM dims",
    "verdicts": "SELECT item_id, model, round(total, 6) AS total, correctness, error_type, round(agreement, 6) AS agreement, round(repeat_std, 6) AS repeat_std, n_judges, low_agreement FROM verdicts",
    "verdict_rationales": "SELECT item_id, model, string_agg('[' || judge || '] ' || error_type, ' | ' ORDER BY rn) AS merged FROM (SELECT *, row_number() OVER (PARTITION BY item_id, model ORDER BY judge, run_idx) AS rn FROM votes WHERE error_type <> '') a WHERE rn <= 3 GROUP BY item_id, model",
    "arbitrated_verdicts": "SELECT item_id, model, round(CASE WHEN used THEN CAST(item_id % 5 + 1 AS DOUBLE) ELSE total END, 6) AS total, CASE WHEN used THEN 'right' ELSE correctness END AS correctness, used AS arbitrated, CASE WHEN used THEN CAST(0.8 AS DOUBLE) END AS confidence FROM (SELECT v.*, low_agreement AND n_judges >= 2 AND v.item_id % 3 = 0 AND model IN ('m0', 'm1') AND v.item_id IN (SELECT item_id FROM items) AS used FROM verdicts v) a",
    "pair_results": "SELECT item_id, model_a, model_b, a_wins, b_wins, ties, winner, round(win_rate_a, 6) AS win_rate_a, round(agreement, 6) AS agreement, consistent, low_agreement FROM pair_results",
    "winrate": f"SELECT model_a, model_b, count(*) AS n_items, round({_RATE}, 6) AS win_rate, count(*) FILTER (WHERE low_agreement) AS low_items, count(*) FILTER (WHERE NOT consistent) AS inconsistent_items FROM pair_results GROUP BY model_a, model_b",
    "winrate_by_category": f"SELECT model_a, model_b, category, count(*) AS n_items, round({_RATE}, 6) AS win_rate, count(*) FILTER (WHERE low_agreement) AS low_items, count(*) FILTER (WHERE NOT consistent) AS inconsistent_items FROM pair_results p JOIN pair_items i ON p.item_id = i.item_id GROUP BY model_a, model_b, category",
    "overview_by_model": f"SELECT model, {_measures()} FROM verdicts GROUP BY model",
    "overview_by_slice": " UNION ALL ".join(
        f"SELECT model, '{kind}' AS slice, {value} AS value, {_measures('v.')} FROM verdicts v JOIN items i ON v.item_id = i.item_id GROUP BY model, {value}"
        for kind, value in (("all", "'all'"), ("category", "category"), ("difficulty", "difficulty"), ("has_ref", "CASE WHEN has_ref THEN 'with reference' ELSE 'without reference' END"))
    ).replace("GROUP BY model, 'all'", "GROUP BY model"),
    "dim_means": "SELECT d.model, dim, round(coalesce(sum(mean_score), 0.0) / max(n), 6) AS mean FROM dims d JOIN (SELECT model, count(*) AS n FROM verdicts GROUP BY model) s ON d.model = s.model JOIN verdicts v ON d.item_id = v.item_id AND d.model = v.model GROUP BY d.model, dim HAVING NOT bool_or(is_na)",
    "dim_gap": "SELECT x.other, x.dim, round(sum(f) / max(n), 6) AS focal_mean, round(sum(o) / max(n), 6) AS other_mean, round((sum(f) - sum(o)) / max(n), 6) AS gap FROM (SELECT b.other, d.dim, CASE WHEN d.model = 'm0' THEN coalesce(mean_score, 0) ELSE 0 END AS f, CASE WHEN d.model = 'm0' THEN 0 ELSE coalesce(mean_score, 0) END AS o, is_na FROM (SELECT a.item_id, c.model AS other FROM verdicts a JOIN verdicts c ON a.item_id = c.item_id WHERE a.model = 'm0' AND c.model <> 'm0') b JOIN dims d ON d.item_id = b.item_id AND d.model IN ('m0', b.other)) x JOIN (SELECT c.model AS other, count(*) AS n FROM verdicts a JOIN verdicts c ON a.item_id = c.item_id WHERE a.model = 'm0' AND c.model <> 'm0' GROUP BY c.model) s ON x.other = s.other GROUP BY x.other, x.dim HAVING NOT bool_or(is_na)",
    "category_histogram": "SELECT category, count(*) AS n FROM items GROUP BY category",
    "ground_truth": "SELECT item_id, CAST(em AS DOUBLE) AS em, round(CAST(f1 AS DOUBLE), 6) AS f1, objective FROM truth",
    "metas": "SELECT item_id, model, CAST(em AS DOUBLE) AS em, round(CAST(f1 AS DOUBLE), 6) AS f1, objective, judged, round(judge_total, 6) AS judge_total, agree, round(CAST(delta AS DOUBLE), 6) AS delta FROM metas",
    "calibration": f"SELECT *, CASE WHEN mean_delta IS NULL THEN 'unknown' WHEN mean_delta > 0.1 THEN 'lenient' WHEN mean_delta < -0.1 THEN 'strict' ELSE 'neutral' END AS bias FROM (SELECT {_META} FROM metas WHERE agree IS NOT NULL) a",
    "calibration_by_category": " UNION ALL ".join(f"SELECT '{k}' AS kind, {k} AS value, {_META} FROM metas m JOIN items i ON m.item_id = i.item_id WHERE agree IS NOT NULL GROUP BY {k}" for k in ("category", "difficulty")),
    "judge_disagreements": "SELECT item_id, model, judged, objective, round(CAST(delta AS DOUBLE), 6) AS delta FROM metas WHERE NOT agree ORDER BY item_id, model LIMIT 50",
    "noref_reliability": "SELECT count(*) AS n, round(avg(agreement), 6) AS mean_agreement, round(avg(CAST(CAST(low_agreement AS INT) AS DOUBLE)), 6) AS low_rate, count(*) FILTER (WHERE low_agreement) AS flagged FROM verdicts WHERE item_id IN (SELECT item_id FROM items WHERE NOT has_ref)",
    "error_normalize": f"SELECT {ERROR_LABEL} AS error_label, count(*) AS n FROM votes GROUP BY 1",
    "skill_route": "SELECT item_id, skill, display FROM routed",
    "skill_label_match": _LABELS,
    "bootstrap_ci": _bootstrap("model_a, model_b", "pv"),
    "bootstrap_by_category": _bootstrap("category", "(SELECT pv.*, category FROM pv JOIN pair_items ON pv.item_id = pair_items.item_id)"),
    "skill_clusters": f"SELECT c.skill, c.error_label, c.count, c.representative, ids, coalesce(keywords, '') AS keywords FROM (SELECT skill, error_label, count(*) AS \"count\", substring(arg_min(question, item_id), 1, 120) AS representative FROM clustered GROUP BY skill, error_label) c JOIN ({_IDS.format(g='skill, error_label', t='clustered')}) i ON c.skill = i.skill AND c.error_label = i.error_label LEFT JOIN words w ON c.skill = w.skill AND c.error_label = w.error_label",
    "keywords": "SELECT * FROM (SELECT lang, keyword, texts, row_number() OVER (PARTITION BY lang ORDER BY texts DESC, keyword) AS rank FROM (SELECT lang, keyword, count(*) AS texts FROM (SELECT *, row_number() OVER (PARTITION BY lang, doc_id ORDER BY n DESC, keyword) AS rn FROM (SELECT lang, doc_id, keyword, count(*) AS n FROM doc_grams WHERE keyword IS NOT NULL GROUP BY ALL) b) c WHERE rn <= 4 GROUP BY lang, keyword) d) e WHERE rank <= 5",
    "dim_problems": "SELECT r.skill, d.dim, count(*) FILTER (WHERE mean_score <= 2) AS \"count\", round(count(*) FILTER (WHERE mean_score <= 2) / CAST(max(n_items) AS DOUBLE), 6) AS rate, coalesce((SELECT string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) FROM (SELECT x.item_id FROM dims x JOIN routed y ON x.item_id = y.item_id WHERE x.model = 'm0' AND y.skill = r.skill AND x.dim = d.dim AND mean_score <= 2 ORDER BY x.item_id LIMIT 10) z), '') AS ids FROM dims d JOIN routed r ON d.item_id = r.item_id JOIN (SELECT skill, count(*) AS n_items FROM routed GROUP BY skill) s ON r.skill = s.skill WHERE d.model = 'm0' GROUP BY r.skill, d.dim HAVING NOT bool_or(is_na)",
    "skill_overview": f"SELECT b.*, round(win_rate, 6) AS win_rate, round(judge_accuracy, 6) AS judge_accuracy FROM (SELECT r.skill, display, count(*) AS n_items, count(v.item_id) AS eval_n, count(*) FILTER (WHERE correctness = 'right') AS right_n, count(v.item_id) - count(*) FILTER (WHERE correctness = 'right') AS problem_n, count(*) - count(v.item_id) AS failed_n, round(count(*) FILTER (WHERE correctness = 'right') / CAST(nullif(count(v.item_id), 0) AS DOUBLE), 6) AS right_rate, round((count(v.item_id) - count(*) FILTER (WHERE correctness = 'right')) / CAST(nullif(count(v.item_id), 0) AS DOUBLE), 6) AS problem_rate, round(avg(total), 6) AS mean_total FROM routed r LEFT JOIN (SELECT * FROM verdicts WHERE model = 'm0') v ON r.item_id = v.item_id GROUP BY r.skill, display) b LEFT JOIN (SELECT skill, {_RATE} AS win_rate FROM pair_results p JOIN routed r ON p.item_id = r.item_id GROUP BY skill) w ON b.skill = w.skill LEFT JOIN (SELECT skill, avg(CAST(CAST(agree AS INT) AS DOUBLE)) AS judge_accuracy FROM metas m JOIN routed r ON m.item_id = r.item_id WHERE agree IS NOT NULL GROUP BY skill) a ON b.skill = a.skill",
    "source_mix": "SELECT skill, category_source, n, round(n / CAST(sum(n) OVER (PARTITION BY skill) AS DOUBLE), 6) AS share FROM (SELECT skill, CASE WHEN i.item_id % 9 = 0 THEN 'fallback_default' ELSE 'dataset' END AS category_source, count(*) AS n FROM items i JOIN routed r ON i.item_id = r.item_id GROUP BY ALL) a",
    "cases_best_worst": "SELECT side, CAST(rank AS INT) AS rank, item_id, round(rate, 6) AS rate FROM (SELECT 'worst' AS side, row_number() OVER (ORDER BY rate, item_id) AS rank, item_id, rate FROM (SELECT item_id, avg(win_rate_a) AS rate FROM pair_results GROUP BY item_id) a UNION ALL SELECT 'best', row_number() OVER (ORDER BY rate DESC, item_id DESC), item_id, rate FROM (SELECT item_id, avg(win_rate_a) AS rate FROM pair_results GROUP BY item_id) b) c WHERE rank <= 5",
    "disagreements": "SELECT item_id, model, round(agreement, 6) AS agreement, correctness FROM (SELECT * FROM verdicts ORDER BY agreement, item_id, model LIMIT 10) a",
    "weaknesses": f"SELECT w.error_type, w.category, count(*) AS \"count\", max(ids) AS ids FROM (SELECT item_id, coalesce(error_type, '未归类') AS error_type, category FROM (SELECT b.item_id, b.error_type, coalesce(i.category, 'default') AS category FROM bad b LEFT JOIN items i ON b.item_id = i.item_id) x) w JOIN ({_IDS.format(g='error_type, category', t='''(SELECT b.item_id, coalesce(b.error_type, '未归类') AS error_type, coalesce(i.category, 'default') AS category FROM bad b LEFT JOIN items i ON b.item_id = i.item_id)''')}) p ON w.error_type = p.error_type AND w.category = p.category GROUP BY w.error_type, w.category",
    "case_cards": "SELECT i.item_id, v.correctness, round(v.total, 6) AS total, round(p.worst_rate, 6) AS worst_rate, m.agree, concat_ws(';', CASE WHEN v.low_agreement THEN '低一致率' END, CASE WHEN v.correctness IN ('wrong', 'partial') THEN 'focal判' || v.correctness END, CASE WHEN NOT m.agree THEN '元评测判错' END, CASE WHEN p.worst_rate < 0.5 THEN 'focal此题落后' END) AS flags FROM items i LEFT JOIN (SELECT * FROM verdicts WHERE model = 'm0') v ON i.item_id = v.item_id LEFT JOIN (SELECT item_id, min(win_rate_a) AS worst_rate FROM pair_results GROUP BY item_id) p ON i.item_id = p.item_id LEFT JOIN (SELECT * FROM metas WHERE model = 'm0') m ON i.item_id = m.item_id",
    "run_summary": "SELECT total, done, total - done AS failed, right_n, done - right_n AS problem_n, round_even(right_n / CAST(done AS DOUBLE), 3) AS accuracy, round_even(m, 2) AS mean_total, round_even(m / 5, 3) AS norm_mean, (SELECT round_even(count(*) FILTER (WHERE agree) / CAST(count(*) AS DOUBLE), 3) FROM metas WHERE model = 'm0') AS judge_accuracy FROM (SELECT count(*) AS total, count(v.item_id) AS done, count(*) FILTER (WHERE v.correctness = 'right') AS right_n, avg(v.total) AS m FROM items i LEFT JOIN (SELECT * FROM verdicts WHERE model = 'm0') v ON i.item_id = v.item_id) a",
    "jobs_todo": "SELECT i.item_id, m.model FROM items i CROSS JOIN (VALUES ('m0'), ('m1'), ('m2'), ('m3')) m(model) WHERE NOT EXISTS (SELECT 1 FROM votes v WHERE v.item_id = i.item_id AND v.model = m.model AND correctness <> 'unclear')",
    "pair_jobs": "SELECT i.item_id, 'm0' AS model_a, b.model AS model_b FROM items i JOIN (SELECT DISTINCT item_id, model FROM votes WHERE NOT used_search) a ON i.item_id = a.item_id JOIN (SELECT DISTINCT item_id, model FROM votes WHERE NOT used_search) b ON i.item_id = b.item_id WHERE NOT i.has_ref AND a.model = 'm0' AND b.model <> 'm0' AND NOT EXISTS (SELECT 1 FROM pair_results p WHERE p.item_id = i.item_id AND p.model_b = b.model)",
    "latest_answers": "SELECT item_id, model, answer, error, seq, ok FROM (SELECT *, row_number() OVER (PARTITION BY item_id, model ORDER BY ok DESC, seq DESC) AS rn FROM (SELECT *, error IS NULL AND answer <> '' AS ok FROM (SELECT user_id AS item_id, event_type AS model, CASE WHEN value > 5 THEN CAST(event_id AS VARCHAR) ELSE '' END AS answer, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'timeout' END AS error, event_id AS seq FROM events) a) b) c WHERE rn = 1",
    "rubric_pivot": "SELECT item_id, model, " + ", ".join(f"coalesce(max(CASE WHEN dim = '{d}' THEN CASE WHEN is_na THEN 'N/A' ELSE coalesce(CAST(round_even(mean_score, 2) AS VARCHAR), '') END END), '') AS {d}" for d in ("accuracy", "completeness", "safety")) + " FROM dims GROUP BY item_id, model",
    "search_merge": "SELECT query_id, place, rank, provider_ord, key FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, provider_ord, key) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY rank, provider_ord) AS rn FROM (SELECT *, CASE WHEN trim(coalesce(url, '')) <> '' THEN trim(url) ELSE lower(substring(title || snippet, 1, 60)) END AS key FROM hits) a) b WHERE rn = 1) c WHERE place <= 20",
    "prompts": f"SELECT item_id, CAST(length({_PROMPT}) AS BIGINT) AS n_chars, sha256({_PROMPT}) AS prompt_sha256 FROM qa",
    "text_ingest": f"SELECT item_id AS line, CASE WHEN k > 0 THEN sha256({_strip('question')}) END AS query_sha, CASE WHEN k > 0 THEN sha256({_strip('answer')}) END AS answer_sha, CASE WHEN k > 1 AND {_strip('reference')} <> '' THEN sha256({_strip('reference')}) END AS reference_sha, CAST(NULL AS VARCHAR) AS competitor, CASE WHEN k = 1 THEN 'seen' END AS context, k = 0 AS failed FROM (SELECT *, item_id % 4 AS k FROM qa) a",
    "html_text": f"SELECT page_id, {_HTML} AS text FROM pages",
    "judgement_rows": f"SELECT o_orderkey AS id, dim, round(CAST(CASE dim WHEN 'accuracy' THEN o_orderkey % 5 + 1 WHEN 'completeness' THEN CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 4 + 1 END ELSE round_even((o_orderkey % 5 + 1 + o_orderkey % 3 + 1) / CAST(2 AS DOUBLE), 0) END AS DOUBLE), 6) AS score, dim = 'completeness' AND o_orderkey % 11 = 0 AS is_na, CASE WHEN dim = 'safety' THEN 'said \"so\" twice' END AS reason, 'repaired' AS status FROM orders, (SELECT unnest(['accuracy', 'completeness', 'safety']) AS dim) d WHERE {_VALID}",
    "parse_judgement": f"SELECT o_orderkey AS id, CASE WHEN {_VALID} THEN 'repaired' ELSE 'failed' END AS status, CASE WHEN {_VALID} THEN CASE WHEN o_orderkey % 2 = 0 THEN 'right' ELSE 'wrong' END END AS correctness, CASE WHEN {_VALID} THEN round(CASE WHEN completeness IS NULL THEN (accuracy + safety) / 2.0 ELSE (accuracy + completeness + safety) / 3.0 END, 6) END AS total, CASE WHEN {_VALID} THEN accuracy END AS accuracy, CASE WHEN {_VALID} THEN completeness END AS completeness, CASE WHEN {_VALID} THEN safety END AS safety FROM (SELECT o_orderkey, CAST(o_orderkey % 5 + 1 AS DOUBLE) AS accuracy, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 4 + 1 AS DOUBLE) END AS completeness, round_even((o_orderkey % 5 + 1 + o_orderkey % 3 + 1) / CAST(2 AS DOUBLE), 0) AS safety FROM orders) a",
    "progress_tails": _TAILS,
    "progress_replayed": _TAILS,
    "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS \"begin\", event_type AS module, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "new_rows": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type",
    "progress_tail": "SELECT item_id, sequence, event_id, module, round(started, 6) AS started_at FROM (SELECT *, last_value(started_at IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS started, row_number() OVER (PARTITION BY item_id ORDER BY sequence DESC) AS rn FROM fx_events) a WHERE rn <= 50",
    "progress_status": "SELECT item_id, count(*) AS events, CAST(CASE WHEN bool_or(module = 'purchase') THEN 4 ELSE coalesce(max(CASE module WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 END), 0) END AS INT) AS stage, round(CASE WHEN bool_or(module = 'purchase') THEN 100.0 ELSE greatest(0.0, least(100.0, max(value))) END, 6) AS percent, CASE WHEN bool_or(module = 'purchase') THEN 'done' WHEN arg_max(module, sequence) = 'error' THEN 'error' ELSE 'running' END AS status FROM fx_events GROUP BY item_id",
    "stream_fold": "SELECT doc_id AS call_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS attempt, 'stop' AS finish_reason, CAST(length(coalesce(text, '')) AS BIGINT) AS tokens, sha256(coalesce(text, '')) AS content_sha256 FROM documents",
    "frame_sessions": "SELECT user_id, CAST(session AS BIGINT) AS session, min(us) AS first, max(us) AS last, count(*) AS n, arg_min(us, event_id) AS kept FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS session FROM (SELECT user_id, event_id, us, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) > 43200000000 THEN 1 ELSE 0 END AS new FROM (SELECT user_id, event_id, epoch_us(ts) AS us FROM events) a) b) c GROUP BY user_id, session",
    "stable_runs": "SELECT video_id, run, \"start\", \"end\", frames, transient FROM stable",
}
ORACLES = {name: oracle(select) for name, select in SELECTS.items()}
