"""SQL of the result, browsing, snapshot, report and store queries, written apart from the operators."""

from __future__ import annotations

from judgelake.operators.reports import OVERVIEW
from judgelake.operators.results import FAILED_SHEET, INTERRUPTED
from judgelake.plans.oracles import ERROR_LABEL, STEPS, _strip, oracle
from judgelake.plans.oracles import SELECTS as CORE

_DIM_ORD = "CASE dim WHEN 'accuracy' THEN 1 WHEN 'completeness' THEN 2 ELSE 3 END"
_CELL = lambda x: f"CAST(round_even({x}, 2) AS VARCHAR)"
_MILLIONTHS = "CAST(round(v.total * 1000000) AS BIGINT)"
_HALF_EVEN = f"({_MILLIONTHS} // 10000 + CASE WHEN {_MILLIONTHS} % 10000 > 5000 OR ({_MILLIONTHS} % 10000 = 5000 AND {_MILLIONTHS} // 10000 % 2 = 1) THEN 1 ELSE 0 END) / 100.0"
_JUDGED = "FROM results WHERE error IS NULL AND correctness IS NOT NULL"
_WEB = f"""SELECT s.*, coalesce(f.label, '—') AS first_cluster, CAST(round_even(n * fallback_share, 0) AS BIGINT) AS fallback_count FROM (
  SELECT coalesce(category, 'default') AS skill, count(*) AS n, count(*) FILTER (WHERE correctness = 'right') AS right_n, count(*) FILTER (WHERE correctness <> 'right') AS problem_n,
         round(avg(total), 6) AS mean_total, round(avg(CASE WHEN category_source = 'fallback_default' THEN 1.0 ELSE 0.0 END), 6) AS fallback_share,
         round(avg(CASE WHEN agree THEN 1.0 WHEN NOT agree THEN 0.0 END), 6) AS judge_accuracy {_JUDGED} GROUP BY 1) s
LEFT JOIN (SELECT skill, label FROM (SELECT skill, label, row_number() OVER (PARTITION BY skill ORDER BY count(*) DESC, label) AS rn FROM (
  SELECT coalesce(category, 'default') AS skill, {ERROR_LABEL} AS label {_JUDGED} AND correctness IN ('wrong', 'partial')) a GROUP BY skill, label) b WHERE rn = 1) f ON s.skill = f.skill"""
_TABS = "SELECT CASE WHEN error IS NOT NULL THEN '__error__' ELSE {category} END AS key, min({shown}) AS shown, count(*) AS n FROM results GROUP BY 1"
_OR_DEFAULT = "coalesce(category, 'default')"
_PLACE = "row_number() OVER (ORDER BY CASE WHEN key = '__error__' THEN 1 ELSE 0 END, n DESC, key)"
_FILL = """WITH RECURSIVE base AS (
    SELECT user_id AS video_id, list(t ORDER BY t) AS ts, coalesce(list(t ORDER BY t) FILTER (WHERE event_type = 'signup'), []) AS p
    FROM (SELECT user_id, CAST(event_id AS DOUBLE) AS t, event_type FROM events) a GROUP BY user_id
), g AS (
    SELECT video_id, ts, p, CASE WHEN len(p) = 0 THEN ts[1:1] ELSE p END AS chosen FROM base
    UNION ALL
    SELECT video_id, ts, p, list_append(chosen, (list_sort(list_transform(list_filter(ts, lambda x: NOT list_contains(chosen, x)),
           lambda x: {'d': -list_min(list_transform(chosen, lambda c: abs(x - c))), 't': x})))[1].t)
    FROM g WHERE len(chosen) < least(16, len(ts))
)
SELECT video_id, t, list_contains(p, t) AS protected FROM (SELECT video_id, p, unnest(chosen) AS t FROM (SELECT video_id, p, arg_max(chosen, len(chosen)) AS chosen FROM g GROUP BY video_id, p) a) b"""
_FETCHES = """SELECT user_id, count(*) AS fetches FROM (
  WITH RECURSIVE e AS (SELECT DISTINCT user_id, epoch_us(ts) / 1e6 AS t FROM events), f AS (
    SELECT user_id, min(t) AS t FROM e GROUP BY user_id
    UNION ALL SELECT e.user_id, min(e.t) AS t FROM f JOIN e ON e.user_id = f.user_id AND e.t - f.t >= {gap} GROUP BY e.user_id)
  SELECT user_id, t FROM f) a GROUP BY user_id"""
_RMS = lambda a, b: f"sqrt((({a}0 - {b}0) ** 2 + ({a}1 - {b}1) ** 2) / 2)"
_FRAME_RUNS = f"""SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY t) AS run FROM (
  SELECT *, CASE WHEN {_RMS('s', 'p')} >= {{threshold}} THEN 1 ELSE 0 END AS new FROM (SELECT *, lag(s0) OVER w AS p0, lag(s1) OVER w AS p1 FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY t)) a) b"""
_TASK_END = f"""SELECT video_id, e AS "end", round(confidence, 6) AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY d DESC, confidence DESC, e DESC) AS rn FROM (
    SELECT *, 0.4 * least(1.0, d / 8.0) + 0.2 * least(1.0, greatest(0.0, ({_RMS('s', 'f')} - 0.04) / 0.08)) + 0.15 * least(1.0, greatest(0.0, (abs(s1 - f1) / 5 - 0.02) / 0.08)) + 0.15 * least(1.0, lasts / 3.0) + 0.1 AS confidence
    FROM (SELECT r.*, r.e - r.s AS d, w.f0, w.f1, w.lasts FROM (SELECT video_id, run, min(t) AS s, max(t) AS e, arg_max(s0, t) AS s0, arg_max(s1, t) AS s1 FROM fr GROUP BY video_id, run) r
      JOIN (SELECT x.video_id, last_run, f0, f1, b1, y.e - y.s AS lasts FROM (SELECT video_id, max(run) AS last_run, arg_max(s0, t) AS f0, arg_max(s1, t) AS f1, arg_min(s1, t) AS b1 FROM fr GROUP BY video_id) x
            JOIN (SELECT video_id, run, min(t) AS s, max(t) AS e FROM fr GROUP BY video_id, run) y ON x.video_id = y.video_id AND x.last_run = y.run) w
      ON r.video_id = w.video_id AND r.run < w.last_run AND abs(w.b1 - w.f1) / 5 <= 0.02 AND w.lasts >= 1.5) c
    WHERE d >= 1.5 AND abs(s1 - f1) / 5 > 0.02) d WHERE confidence >= 0.6) g WHERE rn = 1"""
_PEAKS = f"""SELECT video_id, run, t FROM (
  SELECT p.*, row_number() OVER (PARTITION BY video_id, run ORDER BY least({_RMS('s', 'b')}, {_RMS('s', 'a')}) DESC, t) AS rn FROM (
    SELECT x.video_id, CAST(x.run AS BIGINT) AS run, x.t, x.s0, x.s1, b0, b1, a0, a1 FROM fr x JOIN (
      SELECT *, lag(l0) OVER w AS b0, lag(l1) OVER w AS b1, lead(g0) OVER w AS a0, lead(g1) OVER w AS a1 FROM (
        SELECT video_id, run, min(t) AS s, max(t) AS e, arg_min(s0, t) AS g0, arg_min(s1, t) AS g1, arg_max(s0, t) AS l0, arg_max(s1, t) AS l1 FROM fr GROUP BY video_id, run) r
      WINDOW w AS (PARTITION BY video_id ORDER BY run)) y ON x.video_id = y.video_id AND x.run = y.run
    WHERE y.e - y.s < 1.5 AND {_RMS('b', 'a')} < 0.065) p) q
WHERE rn = 1 AND (CASE WHEN abs(s0 - b0) >= 12.0 / 255 AND abs(s0 - a0) >= 12.0 / 255 THEN 1 ELSE 0 END + CASE WHEN abs(s1 - b1) >= 12.0 / 255 AND abs(s1 - a1) >= 12.0 / 255 THEN 1 ELSE 0 END) / 2.0 BETWEEN 0.02 AND 0.55"""
_STRICT = f"""SELECT video_id, t, protected, priority, round(novelty, 6) AS novelty FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, g ORDER BY protected DESC, priority DESC, novelty DESC, t DESC) AS rn FROM (
    SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY t) AS g FROM (
      SELECT *, CASE WHEN {_RMS('s', 'p')} < 0.008 AND (CASE WHEN abs(s0 - p0) >= 12.0 / 255 THEN 1 ELSE 0 END + CASE WHEN abs(s1 - p1) >= 12.0 / 255 THEN 1 ELSE 0 END) / 2.0 < 0.01 THEN 0 ELSE 1 END AS new FROM (
        SELECT f.*, e.event_type = 'signup' AS protected, e.event_id % 3 AS priority, e.value AS novelty, lag(s0) OVER w AS p0, lag(s1) OVER w AS p1
        FROM frames f JOIN events e ON f.t = e.event_id WINDOW w AS (PARTITION BY video_id ORDER BY t)) a) b) c) d WHERE rn = 1 OR protected"""


def _long(section: str, key: str, detail: str, metrics: list[str], source: str) -> str:
    text = lambda x: f"CAST({x} AS VARCHAR)"
    return " UNION ALL ".join(f"SELECT '{section}' AS section, {text(key)} AS key, {text(detail)} AS detail, '{m}' AS metric, round(CAST(\"{m}\" AS DOUBLE), 6) AS value FROM ({source}) s" for m in metrics)


_FOCAL_DIMS = CORE["dim_means"].replace("HAVING", "HAVING d.model = 'm0' AND")
_REPORT_A = " UNION ALL ".join((
    _long("model", "model", "''", OVERVIEW, CORE["overview_by_model"]),
    _long("winrate", "model_b", "''", ["n_items", "win_rate", "inconsistent_items"], CORE["winrate"]),
    _long("winrate_by_category", "model_b", "category", ["win_rate"], CORE["winrate_by_category"]),
    _long("dim_gap", "other", "dim", ["gap"], CORE["dim_gap"]),
    _long("focal_by_category", "category", "''", ["n", "mean_total"], "SELECT category, count(*) AS n, avg(total) AS mean_total FROM verdicts v JOIN items i ON v.item_id = i.item_id WHERE model = 'm0' GROUP BY category"),
    _long("case", "side || ' ' || CAST(rank AS VARCHAR)", "item_id", ["rate"], CORE["cases_best_worst"]),
    _long("disagreement", "item_id", "model", ["agreement"], CORE["disagreements"]),
    _long("weakness", "error_type", "category", ["count"], CORE["weaknesses"]),
    f"SELECT 'advice', CASE WHEN win_rate < 0.45 THEN 'behind' WHEN win_rate > 0.55 THEN 'ahead' ELSE 'level' END, model_b, 'win_rate', win_rate FROM ({CORE['winrate']}) s",
    f"SELECT 'advice', 'weak dimension', dim, 'mean', mean FROM (SELECT * FROM ({_FOCAL_DIMS}) t WHERE mean < 3 ORDER BY mean, dim LIMIT 5) s",
    f"SELECT 'advice', 'judges often disagree', '', 'low_rate', low_rate FROM ({CORE['overview_by_model']}) s WHERE model = 'm0' AND low_rate > 0.2",
))
_REPORT_B = " UNION ALL ".join((
    _long("summary", "bias", "''", ["n", "accuracy", "mean_delta", "pearson"], CORE["calibration"]),
    _long("accuracy_by", "kind", "value", ["n", "accuracy"], CORE["calibration_by_category"]),
    _long("without_reference", "''", "''", ["n", "mean_agreement", "low_rate", "flagged"], CORE["noref_reliability"]),
    _long("disagreement", "item_id", "model", ["delta"], CORE["judge_disagreements"]),
    _long("conclusion", "CASE WHEN accuracy IS NULL THEN 'unknown' WHEN accuracy >= 0.85 THEN 'reliable' WHEN accuracy >= 0.7 THEN 'usable with spot checks' ELSE 'not reliable enough' END", "''", ["accuracy"], CORE["calibration"]),
))
_CLUSTERS = f"SELECT skill, error_label, \"count\", row_number() OVER (PARTITION BY skill ORDER BY \"count\" DESC, error_label) AS place FROM ({CORE['skill_clusters']}) s"
_MIX = CORE["source_mix"].replace("i.item_id % 9 = 0", "coalesce(i.category, '') IN ('', 'default')")
_DOMAIN = f"SELECT b.*, coalesce(f.error_label, '—') AS first_cluster, CAST(round_even(n_items * coalesce(x.share, 0.0), 0) AS BIGINT) AS fallback_count FROM ({CORE['skill_overview']}) b LEFT JOIN (SELECT * FROM ({_CLUSTERS}) c WHERE place = 1) f ON b.skill = f.skill LEFT JOIN (SELECT * FROM ({_MIX}) m WHERE category_source = 'fallback_default') x ON b.skill = x.skill"
_REPORT_C = " UNION ALL ".join((
    _long("overview", "skill", "first_cluster", ["n_items", "eval_n", "right_n", "problem_n", "failed_n", "right_rate", "problem_rate", "mean_total", "win_rate", "judge_accuracy", "fallback_count"], _DOMAIN),
    _long("cluster", "skill", "error_label", ["place", "count"], _CLUSTERS),
    _long("dim_problem", "skill", "dim", ["count", "rate"], CORE["dim_problems"]),
    _long("source", "skill", "category_source", ["n", "share"], _MIX),
    _long("run", "''", "''", ["verdicts", "models"], "SELECT count(*) AS verdicts, count(DISTINCT model) AS models FROM verdicts"),
))

STEPS.update({
    "runs_peaks": _FRAME_RUNS.format(threshold="0.05"), "runs_end": _FRAME_RUNS.format(threshold="0.065"),
    "replay_events": "SELECT item_id % 5 AS task_id, item_id, sequence FROM fx_events",
    "replay_done": "SELECT DISTINCT item_id % 5 AS task_id, item_id FROM fx_events WHERE module = 'purchase' OR item_id % 5 = 1",
    "replay_frames": """SELECT task_id, 0 AS k, item_id, sequence FROM (SELECT *, row_number() OVER (PARTITION BY task_id, item_id ORDER BY sequence DESC) AS rn FROM replay_events) x WHERE rn <= 20
UNION ALL SELECT task_id, 1, item_id, max(sequence) FROM replay_events GROUP BY task_id, item_id UNION ALL SELECT task_id, 2, item_id, 0 FROM replay_done
UNION ALL SELECT task_id, 3, NULL, 0 FROM (SELECT e.task_id, count(DISTINCT e.item_id) AS n, count(DISTINCT d.item_id) AS m FROM replay_events e LEFT JOIN replay_done d ON e.item_id = d.item_id GROUP BY e.task_id) y WHERE n = m""",
})

_ESCAPED = "replace(replace(text, chr(13), '\\r'), chr(10), '\\n')"
_NAMED = lambda x, most: f"coalesce(nullif(substring(regexp_replace(trim(coalesce({x}, '')), '[^0-9a-zA-Z_-]', '_', 'g'), 1, {most}), ''), 'sheet')"
_SCORED = lambda d: f"CASE WHEN {d} = 'safety' AND item_id % 13 = 0 THEN 'N/A|' ELSE coalesce(CAST(CASE {d} WHEN 'accuracy' THEN accuracy WHEN 'safety' THEN safety END AS VARCHAR), '') || '|' || CASE WHEN {d} = 'accuracy' THEN coalesce(query, '') ELSE '' END END"
_EXPORT = f"""SELECT task_id, sheet, position, 'task_id|item_id|category|category_display|error|total|wins|' || array_to_string(list_transform(ds, lambda d: '维度_' || d || '|理由_' || d), '|') AS header,
    concat_ws('|', task_id, item_id, coalesce(category, ''), coalesce(category_display, ''), coalesce(error, ''), coalesce(CAST(total AS VARCHAR), ''), '{{"a_wins":' || a_wins || ',"b_wins":' || b_wins || '}}', array_to_string(list_transform(ds, lambda d: {_SCORED('d')}), '|')) AS cells
FROM (
    SELECT *, row_number() OVER (PARTITION BY task_id, kind, skill ORDER BY item_id) AS position,
        CASE kind WHEN 0 THEN '逐题结果' WHEN 2 THEN '评估失败' ELSE '逐题-' || first_value(shown) OVER (PARTITION BY task_id, kind, skill ORDER BY item_id) END AS sheet,
        CASE WHEN kind = 1 AND own = 'music' THEN ['taste', 'accuracy'] WHEN kind = 1 THEN ['accuracy', 'safety'] ELSE
            list_concat(['accuracy'], list_concat(CASE WHEN bool_or(own <> 'music') OVER g THEN ['safety'] ELSE [] END, CASE WHEN bool_or(own = 'music') OVER g THEN ['taste'] ELSE [] END)) END AS ds
    FROM (
        SELECT r.*, coalesce(category, 'default') AS own, coalesce(category_display, category, 'default') AS shown, 0 AS kind, '' AS skill FROM results r JOIN snapshots s ON s.task_id = r.task_id
        UNION ALL
        SELECT r.*, coalesce(category, 'default'), coalesce(category_display, category, 'default'), CASE WHEN r.error IS NULL THEN 1 ELSE 2 END, CASE WHEN r.error IS NULL THEN coalesce(category, 'default') ELSE '' END
        FROM results r JOIN snapshots s ON s.task_id = r.task_id WHERE mode <> 'compare'
    ) a WINDOW g AS (PARTITION BY task_id, kind, skill)
) b"""

SELECTS = {
    "result_rows": f"""SELECT v.item_id, v.model, correctness, {_HALF_EVEN} AS total, coalesce(error_type, '') AS error_type, concat_ws('  ||  ', rationale, why) AS rationale, used_search, truncated, low_agreement FROM verdicts v
JOIN (SELECT item_id, model, 'judged ' || arg_min(correctness, judge || lpad(CAST(run_idx AS VARCHAR), 9, '0')) AS rationale, bool_or(used_search) AS used_search, bool_or(total > 4) AS truncated FROM votes GROUP BY item_id, model) a ON v.item_id = a.item_id AND v.model = a.model
LEFT JOIN (SELECT item_id, model, string_agg(dim || '：' || CASE WHEN mean_score <= 2 THEN 'low' ELSE 'fine' END, ' ｜ ' ORDER BY {_DIM_ORD}) AS why FROM dims WHERE NOT is_na GROUP BY item_id, model) b ON v.item_id = b.item_id AND v.model = b.model""",
    "wide_rubric": f"SELECT item_id, coalesce({_CELL('accuracy')}, '') AS score_accuracy, CASE WHEN item_id % 2 = 0 THEN 'accuracy even' ELSE '' END AS reason_accuracy, CASE WHEN item_id % 13 = 0 THEN 'N/A' ELSE coalesce({_CELL('safety')}, '') END AS score_safety, CASE WHEN item_id % 13 <> 0 AND item_id % 2 = 0 THEN 'safety even' ELSE '' END AS reason_safety FROM results",
    "dim_names": "SELECT task_id, string_agg(DISTINCT dim, ',' ORDER BY dim) AS dims FROM (SELECT task_id, item_id, 'accuracy' AS dim, accuracy AS score FROM results UNION ALL SELECT task_id, item_id, 'safety', safety FROM results) a WHERE score IS NOT NULL GROUP BY task_id",
    "result_page": "SELECT item_id, category, correctness, accuracy, query FROM (SELECT *, row_number() OVER (ORDER BY item_id) AS rn, count(*) OVER () AS n FROM results WHERE error IS NULL AND category = 'search' AND correctness = 'wrong' AND accuracy <= 2 AND lower(concat_ws(' ', CAST(item_id AS VARCHAR), query, answer)) LIKE '%low%') a WHERE (rn - 1) // 10 = least(1, greatest(0, (n - 1) // 10))",
    "skill_tabs": f"SELECT key, CASE WHEN key = '__error__' THEN '{FAILED_SHEET}' ELSE coalesce(shown, key) END AS label, n, {_PLACE} AS position FROM ({_TABS.format(category='category', shown='category_display')}) a WHERE key IS NOT NULL",
    "result_sheets": f"SELECT key, CASE WHEN key = '__error__' THEN '{FAILED_SHEET}' ELSE '逐题-' || coalesce(shown, key) END AS sheet, {_PLACE} AS position, n FROM ({_TABS.format(category=_OR_DEFAULT, shown='coalesce(category_display, ' + _OR_DEFAULT + ')')}) a",
    "snapshot_list": f"""SELECT s.task_id, strftime(make_timestamp(created_at * 1000000), '%Y%m%d_%H%M%S') || '_' || replace(mode, ' ', '_') || '_' || CAST(s.task_id AS VARCHAR) AS session_name, CASE WHEN status IN ('pending', 'running') THEN 'error' ELSE status END AS status,
coalesce(total, 0) AS total, coalesce(done, 0) AS done, CASE WHEN status IN ('pending', 'running') THEN coalesce(error, '{INTERRUPTED}') ELSE error END AS error, strftime(make_timestamp(created_at * 1000000), '%Y-%m-%d %H:%M:%S') AS created
FROM (SELECT * FROM snapshots ORDER BY created_at DESC, task_id LIMIT 50) s LEFT JOIN (SELECT task_id, count(*) AS total, count(*) FILTER (WHERE error IS NULL) AS done FROM results GROUP BY task_id) r ON s.task_id = r.task_id""",
    "prompt_contexts": "SELECT item_id, sha256(CASE WHEN item_id % 3 = 0 AND trim(answer, ' \n\t\r') <> '' THEN trim(answer, ' \n\t\r') ELSE '当前时间：2024年02月29日 08:00:00（时区：UTC+00:00）' END) AS context_sha FROM qa",
    "percent_text": "SELECT item_id, CASE WHEN accuracy IS NULL THEN '—' ELSE format('{:.1f}%', accuracy / 8 * 100) END AS share FROM results",
    "judge_assignments": "SELECT item_id, 'j2' AS judge, 'balanced' AS persona FROM qa UNION ALL SELECT item_id, 'j1', 'product_expert' FROM qa WHERE item_id % 3 > 0 AND trim(answer) <> ''",
    "chosen_judges": "SELECT judge, -count(*) AS ord, max(CASE WHEN used_search THEN 'strict' ELSE 'balanced' END) AS persona FROM votes GROUP BY judge ORDER BY ord LIMIT 1",
    "judges_summary": f"SELECT item_id, model, string_agg(judge || '/' || correctness || '/' || {_CELL('total')}, '; ' ORDER BY judge, run_idx) AS summary FROM votes GROUP BY item_id, model",
    "web_verdict_overview": f"SELECT 'answer' AS model, correctness, count(*) AS n, round(avg(coalesce(total, 0)), 6) AS mean_total {_JUDGED} GROUP BY correctness",
    "web_overview": _WEB,
    "fallback_share": f"SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(fallback_count) AS BIGINT) AS fallback, round(sum(fallback_count) / CAST(sum(n) AS DOUBLE), 6) AS rate FROM ({_WEB}) w",
    "compare_summary": "SELECT count(*) AS total, count(*) FILTER (WHERE error IS NULL) AS done, count(*) FILTER (WHERE error IS NOT NULL) AS failed, round_even(sum(a_wins + 0.5 * ties) FILTER (WHERE error IS NULL) / CAST(sum(a_wins + b_wins + ties) FILTER (WHERE error IS NULL) AS DOUBLE), 3) AS a_winrate FROM results",
    "category_histogram_multi": "SELECT category, count(*) AS n FROM (SELECT unnest(string_split(category, ' ')) AS category FROM items) a GROUP BY category",
    "cluster_order": _CLUSTERS,
    "trace_examples": "SELECT v.item_id, v.model, v.correctness, 'search' AS trace FROM verdicts v JOIN (SELECT item_id, model, arg_min(used_search, judge || lpad(CAST(run_idx AS VARCHAR), 9, '0')) AS used FROM votes GROUP BY item_id, model) t ON v.item_id = t.item_id AND v.model = t.model WHERE used ORDER BY v.item_id, v.model LIMIT 8",
    "image_redaction": "SELECT conv_id, turn, role, coalesce(substring(text, 1, 20), '-') || '|' || CASE WHEN turn % 2 = 1 THEN '-' WHEN turn < 2 THEN '[frame → f' || CAST(conv_id AS VARCHAR) || ']' ELSE '[frame → (base64 省略)]' END AS parts FROM conversations",
    "call_records": """SELECT o_orderkey, concat_ws(';', CASE WHEN o_orderkey % 5 > 0 THEN 'completion_tokens=' || CAST(o_orderkey % 50 AS VARCHAR) END, CASE WHEN o_orderkey % 7 = 0 THEN 'error=slow' END, CASE WHEN o_orderkey % 7 = 0 THEN 'http_status=429' END,
CASE WHEN o_orderkey % 3 > 0 THEN 'prompt_tokens=' || CAST(o_orderkey % 100 AS VARCHAR) END, 'total_tokens=' || CAST(coalesce(CASE WHEN o_orderkey % 2 > 0 THEN o_orderkey % 200 END, CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 5 > 0 THEN o_orderkey % 100 + o_orderkey % 50 END) AS VARCHAR)) AS record FROM orders""",
    "first_seen": "SELECT item_id, module, row_number() OVER (PARTITION BY item_id ORDER BY min(sequence), module) AS place FROM fx_events GROUP BY item_id, module",
    "union_by_identity": "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN correctness END AS correctness, round(CASE WHEN item_id % 3 > 0 THEN total END, 6) AS total FROM results WHERE item_id % 3 = 0 OR item_id % 2 = 0",
    "outcome_split": "SELECT task_id, item_id, CASE WHEN error IS NULL THEN 'ok' ELSE 'failed' END AS outcome, row_number() OVER (PARTITION BY task_id, error IS NULL ORDER BY item_id) AS place FROM results",
    "problem_preview": "SELECT category, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY item_id) AS rn FROM results WHERE accuracy <= 2 AND category IS NOT NULL) a WHERE rn <= 10 GROUP BY category",
    "progress_replay": "SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY k, item_id, sequence) AS position, CASE k WHEN 0 THEN 'progress_event' WHEN 1 THEN 'item_progress' WHEN 2 THEN 'result' ELSE 'done' END AS kind, item_id, sequence FROM replay_frames",
    "progress_reconciled": "SELECT item_id, CASE WHEN there AND error IS NOT NULL THEN 'error' WHEN there THEN 'done' WHEN ended THEN status ELSE 'error' END AS status, CASE WHEN there AND error IS NOT NULL THEN '评测失败' WHEN there THEN '评测完成' WHEN ended THEN '' ELSE '任务中断：lost' END AS message, CAST(100.0 AS DOUBLE) AS percent FROM (SELECT item_id, error, item_id % 4 = 0 AS there, item_id % 3 > 0 AND item_id % 5 < 2 AS ended, CASE WHEN item_id % 5 = 0 THEN 'done' ELSE 'error' END AS status FROM results) a",
    "tool_calls": "SELECT doc_id AS call_id, 0 AS index, 'c' || CAST(doc_id AS VARCHAR) AS id, 'search' AS name, sha256(coalesce(text, '')) AS arguments_sha FROM documents",
    "stream_outcomes": "SELECT CASE WHEN event_id % 4 = 0 THEN 'no_choice' WHEN event_id % 6 IN (2, 5) THEN 'retry' WHEN event_id % 6 = 1 THEN 'blocked' WHEN event_id % 6 = 4 THEN 'unfinished' ELSE 'ok' END AS outcome, count(*) AS n FROM events GROUP BY 1",
    "cache_use": f"SELECT q.user_id, requests, fetches, requests - fetches AS hits FROM (SELECT user_id, count(*) AS requests FROM events GROUP BY user_id) q JOIN ({_FETCHES.format(gap='3600.0')}) f ON q.user_id = f.user_id",
    "uniform_plan": "SELECT video_id, CAST(k AS INT) AS place, round(7.0 + CASE WHEN n > 1 THEN k * value / (n - 1) ELSE 0 END, 6) AS t FROM (SELECT video_id, value, n, unnest(range(n)) AS k FROM (SELECT event_id AS video_id, value, CAST(greatest(1, least(16, floor((7.0 + value) - 7.0) + 1)) AS INT) AS n FROM events) a) b",
    "transient_peaks": _PEAKS.replace(" fr ", " runs_peaks "),
    "task_end": _TASK_END.replace(" fr ", " runs_end "),
    "strict_duplicates": _STRICT,
    "min_gap_dedupe": _FETCHES.format(gap="21600.0").replace("SELECT user_id, count(*) AS fetches FROM (", "SELECT user_id, round(t, 6) AS kept FROM (").replace(") a GROUP BY user_id", ") a"),
    "progress_stream": CORE["progress_tail"],
    "farthest_fill": _FILL,
    "verdicts_added": CORE["verdicts"],
    "pasted_items": f"""SELECT 'q' || doc_id AS id, sha256({_strip("regexp_replace(substring(coalesce(text, ''), 1, 30), '[|" + chr(92) + "n" + chr(92) + "r]', ' ', 'g')")}) AS question_sha, coalesce(length(text) > 400, false) AS has_ref,
        CASE WHEN length(text) > 400 THEN lang END AS reference, 'default' AS category, lang AS answer, CASE WHEN doc_id % 2 = 0 THEN source END AS competitor FROM documents""",
    "classified_once": """SELECT id, CASE WHEN category IS NOT NULL THEN category ELSE coalesce(label, 'default') END AS category,
        CASE WHEN category IS NOT NULL THEN 'dataset' WHEN label IS NOT NULL THEN 'auto_classified' ELSE 'fallback_default' END AS category_source, 0 AS scored_again
        FROM (SELECT p_partkey AS id, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN p_type END AS category, CASE WHEN NOT contains(p_name, 'red') THEN split_part(p_name, ' ', 2) END AS label FROM part) a""",
    "scoring_dims": """SELECT item_id, judge, scoring, s.dim_set, dim, dim_ord FROM (
        SELECT item_id, judge, scoring, CASE WHEN scoring IN ('operation', 'process') THEN scoring WHEN skill = 'music' THEN 'music' ELSE 'base' END AS dim_set FROM (
            SELECT item_id, judge, category AS skill, CASE WHEN a_wins + b_wins = 2 THEN 'operation' WHEN a_wins + b_wins = 1 AND total > 2 THEN 'process' WHEN judge = 'j1' AND low_agreement THEN 'compare' ELSE 'result' END AS scoring
            FROM results, (SELECT unnest(['j0', 'j1']) AS judge) j) a) b
        JOIN (SELECT unnest(['base', 'base', 'base', 'process', 'operation', 'music', 'music']) AS dim_set, unnest(['accuracy', 'completeness', 'safety', 'steps', 'done', 'taste', 'accuracy']) AS dim, unnest([0, 1, 2, 0, 0, 0, 1]) AS dim_ord) s ON s.dim_set = b.dim_set""",
    "arbitrated_fully": """SELECT v.item_id, v.model, CASE WHEN used THEN CASE WHEN v.item_id % 2 = 0 THEN 'wrong' ELSE 'unclear' END ELSE correctness END AS correctness,
        round(CASE WHEN NOT used THEN total WHEN v.item_id % 3 = 1 THEN round_even(v.item_id % 7 + CAST(0.375 AS DOUBLE), 2) ELSE round_even(r.mean, 2) END, 6) AS total, CASE WHEN used THEN r.rubric END AS rubric,
        CASE WHEN used THEN '[主席仲裁·置信度0.5] ' || v.model ELSE 'by vote' END AS rationale, used AS arbitrated, CASE WHEN used THEN CAST(0.5 AS DOUBLE) END AS confidence
        FROM (SELECT *, low_agreement AND n_judges >= 2 AND item_id % 3 > 0 AS used FROM verdicts) v
        JOIN (SELECT item_id, model, coalesce(avg(floor(mean_score + 0.7)), 0.0) AS mean, coalesce(string_agg(dim || '=' || CAST(floor(mean_score + 0.7) AS DOUBLE), ',' ORDER BY dim) FILTER (WHERE mean_score IS NOT NULL), '') AS rubric FROM dims GROUP BY item_id, model) r ON v.item_id = r.item_id AND v.model = r.model""",
    "snapshot_versions": "SELECT 'first' AS version, category, count(*) AS n FROM results WHERE error IS NULL GROUP BY category UNION ALL SELECT 'newest', category, count(*) FROM results GROUP BY category",
    "arithmetic": "SELECT o_orderkey, CASE WHEN o_orderkey % 9 > 2 THEN round((o_orderkey + 3) * -2.0 + 3 - (o_orderkey % 25) / 4.0, 6) END AS value FROM orders",
    "safe_arguments": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '\"say \\\"no\\\"\"' WHEN 1 THEN '{\"a\": 1}' ELSE '{}' END AS arguments FROM events",
    "trace_outputs": "SELECT conv_id, sha256(coalesce(arg_max(text, turn) FILTER (WHERE turn < 2 AND text <> ''), '')) AS output_sha FROM conversations GROUP BY conv_id",
    "allowed_paths": "SELECT o_orderkey, o_orderkey % 6 = 0 AS allowed FROM orders",
    "manifest_compare": """SELECT k AS line, CASE WHEN ok AND k % 7 > 0 THEN 'q ' || CAST(k AS VARCHAR) END AS query, CASE WHEN ok AND k % 5 = 1 THEN 'seen' END AS context, CASE WHEN ok THEN 'a' END AS answer_a, CASE WHEN ok AND k % 4 > 0 THEN 'b' || CAST(k AS VARCHAR) END AS answer_b, CAST(NULL AS VARCHAR) AS reference, CAST(NULL AS VARCHAR) AS category,
CASE WHEN NOT ok THEN 'not a JSON object' WHEN k % 7 = 0 THEN 'no question' WHEN k % 5 = 0 THEN 'context must be text' WHEN k % 4 = 0 THEN 'no answer_b' END AS error FROM (SELECT o_orderkey AS k, o_orderkey % 11 > 1 AS ok FROM orders) a""",
    "stored_votes": "SELECT model, correctness, count(*) AS n FROM votes GROUP BY model, correctness",
    "report_a": _REPORT_A, "report_b": _REPORT_B, "report_c": _REPORT_C,
    "export_sheets": _EXPORT,
    "trace_rows": """SELECT v.item_id, model, judge, run_idx, v.error_type, coalesce(r.correctness, v.correctness) AS correctness, round(coalesce(r.total, v.total), 6) AS total, category_source,
        CASE WHEN r.correctness <> v.correctness THEN v.correctness END AS call_correctness, CASE WHEN r.total <> v.total THEN v.total END AS call_total FROM votes v LEFT JOIN results r ON r.item_id = v.item_id""",
    "log_lines": f"""SELECT doc_id, coalesce(lang, '-') AS lang_shown, sha256(concat_ws(' | ', '语言=' || nullif(lang, ''), '长文=' || CASE WHEN n_chars > 1000 THEN '是' WHEN n_chars <= 1000 THEN '否' END, '来源=' || CAST(to_json([source, lang]) AS VARCHAR),
        '字数=' || n_chars, CASE WHEN text <> '' THEN '文本=' || CASE WHEN regexp_matches({_ESCAPED}, '[\\s\\p{{Z}}|=]') THEN CAST(to_json({_ESCAPED}) AS VARCHAR) ELSE {_ESCAPED} END END)) AS line_sha FROM documents""",
    "json_answers": f"""SELECT conv_id, turn, sha256({_strip('text')}) AS answer_sha, sha256(coalesce(text, '')) AS first_sha, role AS second, CAST(NULL AS VARCHAR) AS third FROM conversations""",
    "even_positions": """SELECT user_id, n, CAST(CASE WHEN k <= 1 THEN 0 ELSE round_even(i * (n - 1) / CAST(k - 1 AS DOUBLE), 0) END AS INT) AS place FROM (
        SELECT user_id, n, k, unnest(range(k)) AS i FROM (SELECT user_id, CAST(count(*) AS INT) AS n, CAST(least(count(*), 16) AS INT) AS k FROM events GROUP BY user_id) a) b""",
    "metas_of_answers": """SELECT item_id, model, em, round(CAST(f1 AS DOUBLE), 6) AS f1, objective, correctness AS judged, round(total, 6) AS judge_total, CASE WHEN correctness <> 'unclear' THEN correctness = objective END AS agree, round(total / 5 - f1, 6) AS delta FROM (
        SELECT *, CASE WHEN em = 1.0 OR f1 >= 0.85 THEN 'right' WHEN f1 >= 0.4 THEN 'partial' ELSE 'wrong' END AS objective FROM (
            SELECT *, CASE WHEN p = r THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS em, CASE WHEN p = '' OR r = '' THEN 0.0 ELSE 2.0 * coalesce(list_sum(list_transform(list_distinct(string_split(p, '')), lambda c: least(length(p) - length(replace(p, c, '')), length(r) - length(replace(r, c, ''))))), 0) / (length(p) + length(r)) END AS f1 FROM (
                SELECT v.item_id, v.model, v.correctness, v.total, CASE v.model WHEN 'm0' THEN regexp_replace(lower(i.reference), '[^a-z0-9]', '', 'g') WHEN 'm1' THEN CASE WHEN v.item_id % 4 > 0 THEN regexp_replace(lower(i.question), '[^a-z0-9]', '', 'g') ELSE '' END ELSE '' END AS p, regexp_replace(lower(i.reference), '[^a-z0-9]', '', 'g') AS r
                FROM verdicts v JOIN items i ON i.item_id = v.item_id WHERE i.reference <> '') a) b) c""",
    "call_requests": """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_orderkey END AS prompt_tokens, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 > 0 THEN o_custkey END AS completion_tokens, CASE WHEN o_orderstatus = 'O' THEN length(o_orderpriority) END AS reasoning_tokens,
        '错误=' || o_orderstatus || '|HTTP状态=' || CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 600 AS VARCHAR) ELSE '-' END || '|服务商请求ID=-' || CASE WHEN o_orderkey % 5 = 0 THEN '|响应=body' ELSE '' END AS details,
        strftime(make_timestamp((1700000000 + o_orderkey * 61) * 1000000), '%y%m%d%H%M') || '_' || substring(sha256(CAST(o_orderkey AS VARCHAR)), 1, 6) || '_q' || o_custkey AS request_id FROM orders""",
    "retriable_calls": f"""SELECT doc_id, coalesce(n_chars % 600 IN (408, 409, 429, 500, 502, 503, 504), false) OR regexp_matches(lower(coalesce(text, '')), 'time.?out|connection|temporar|overloaded|rate.?limit') AS again,
        {_NAMED('source', 12)} AS name, {_NAMED('substring(text, 1, 200)', 31)} AS sheet FROM documents""",
    "plain_verdict_dims": "SELECT item_id, model, dim, round(avg(score), 6) AS mean_score, bool_and(is_na) AS is_na FROM vote_dims GROUP BY item_id, model, dim",
}
ORACLES = {name: oracle(select) for name, select in SELECTS.items()}
