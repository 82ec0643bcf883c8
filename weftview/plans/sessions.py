"""Registered queries over sessions and responses
(A6-A7, B8, B11, B13, D12, G2-G4, H1-H3, J1, K2, K4, K6, L2).

Inputs are derived from the driver tables:

* ``events`` -> navigation events: session = ``user_id``, order ``(ts, event_id)``,
  URL from ``props.k``; ``signup`` is a *back*, every other type a *visit*,
  ``error`` a visit whose page failed to load.
* ``events`` -> task events: ``view`` = navigate, ``click`` = loading,
  ``purchase`` = loaded, ``error`` = error; the view is chosen by ``k``.
* ``events`` -> tab activations (``click``) and failed completions (``error``).
* ``conversations`` -> response chunks: ``conv_id`` = response, ``turn`` = seq,
  ``text`` = chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggs import ordered_join
from ..functions.patterns import DEFAULT_MODEL, HISTORY_CAP, SNAPSHOT_EVERY
from ..functions.sqltext import lit
from ..operators import chunks as C
from ..operators import navigation as N
from ..operators.views import (
    DEFAULT_VIEWS,
    VIEW_ID_PREFIX,
    error_content,
    fan_out,
    normalize_view_id,
    settings_overlay,
    status_label,
    task_model,
    view_specs,
)
from ..sources.tables import table

# --- fixed values: how driver tables map onto sessions --------------------------
NAV_URL_PREFIX = "https://site.example/p/"
TASK_EVENTS = {"view": "navigate", "click": "loading", "purchase": "loaded", "error": "error"}
TASK_VIEWS = [v[0] for v in DEFAULT_VIEWS]


def nav_events(spark, d) -> DataFrame:
    return nav_from(table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "props"))


def nav_from(e: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return e.select(F.col("user_id").alias("session_id"), "ts", F.col("event_id").alias("seq"),
                    F.when(F.col("event_type") == "signup", "back").otherwise("visit").alias("op"),
                    F.concat(F.lit(NAV_URL_PREFIX), k).alias("url"),
                    (F.col("event_type") != "error").alias("ok"))


def nav_dedup(spark, d):
    return N.visits_deduped(nav_events(spark, d)).select("session_id", "seq", "url")


def nav_last_n(spark, d):
    v = N.visits_deduped(nav_events(spark, d), keep_bucket=True)
    return N.last_n(v, HISTORY_CAP).select("session_id", "seq", "url", "from_end")


def nav_history(spark, d):
    return N.history(nav_events(spark, d), HISTORY_CAP)


def current_page(spark, d):
    return N.current_page(nav_events(spark, d)).select("session_id", "seq", "current_url")


def task_events(spark, d) -> DataFrame:
    return tasks_from(table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "props"))


def tasks_from(e: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    ev = F.create_map(*[F.lit(x) for kv in TASK_EVENTS.items() for x in kv])[F.col("event_type")]
    views = F.array(*[F.lit(v) for v in TASK_VIEWS])
    return e.where(F.col("event_type").isin(*TASK_EVENTS)).select(
        F.col("user_id").alias("session_id"), "ts", F.col("event_id").alias("seq"),
        ev.alias("event"), F.element_at(views, (F.pmod(k, F.lit(len(TASK_VIEWS))) + 1).cast("int"))
        .alias("view_id"))


def _task_state(spark, d) -> DataFrame:
    """Last status per (session, view) since the session's last navigate.

    One aggregation (partial aggregation absorbs a hot session) and a window over its few rows
    a session; ``error`` counts as loaded.
    """
    te = task_events(spark, d).withColumn("of", F.when(F.col("event") != "navigate", F.col("view_id")))
    s = te.groupBy("session_id", "of").agg(F.max_by("event", F.struct("ts", "seq")).alias("last"), F.max(F.struct("ts", "seq")).alias("at"))
    # a row a view from here on, and one for the session's last navigate
    nav_at = F.max(F.when(F.col("of").isNull(), F.col("at"))).over(Window.partitionBy("session_id"))
    s = s.withColumn("nav_at", nav_at).where(F.col("of").isNotNull() & (F.col("nav_at").isNull() | (F.col("at") > F.col("nav_at"))))
    return s.select("session_id", F.col("of").alias("view_id"), F.when(F.col("last") == "loading", "loading").otherwise("loaded").alias("status"))


def task_status(spark, d):
    s = _task_state(spark, d)
    names = F.create_map(*[F.lit(x) for v in view_specs(spark) for x in (v["id"], v["name"])])
    return s.select("session_id", "view_id", "status",
                    status_label(F.col("status"), names[F.col("view_id")]).alias("label"))


def task_totals(spark, d):
    s = _task_state(spark, d)
    return s.groupBy("session_id").agg(
        F.count_if(F.col("status") == "loaded").cast("long").alias("n_loaded"),
        F.count_if(F.col("status") == "loading").cast("long").alias("n_loading"))


def on_demand_tasks(spark, d):
    """On-demand views a session may start: not eager, neither loading nor loaded.

    Sessions that have a page (a navigate) only; the view list is the config
    array exploded per session (no join).
    """
    te = task_events(spark, d)
    has_page = te.where(F.col("event") == "navigate").select("session_id").distinct()
    lazy = [v for v in view_specs(spark) if not v["auto_load"]]
    wanted = fan_out(has_page, lazy, {"view_id": "id"})
    busy = _task_state(spark, d).select("session_id", "view_id")
    return wanted.join(busy, ["session_id", "view_id"], "left_anti")


# --- fixed values: tab ids seen in click events (the last one is not a view) ----
TAB_IDS = TASK_VIEWS + ["settings"]
ERROR_KINDS = ["auth", "runtime", "unexpected"]


def view_events(spark, d):
    """Tab activations from click events; prefixed ids normalised, unknown flagged."""
    return _tab_events(spark, d).drop("ts")


def _tab_events(spark, d) -> DataFrame:
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "props")
    k = F.get_json_object("props", "$.k").cast("long")
    vid = F.element_at(F.array(*[F.lit(v) for v in TAB_IDS]),
                       (F.pmod(k, F.lit(len(TAB_IDS))) + 1).cast("int"))
    raw = F.when(F.pmod(F.floor(k / len(TAB_IDS)), F.lit(2)) == 0,
                 F.concat(F.lit(VIEW_ID_PREFIX), vid)).otherwise(vid)
    known = [v["id"] for v in view_specs(spark)]
    x = e.where(F.col("event_type") == "click").select(
        F.col("user_id").alias("session_id"), "ts", F.col("event_id").alias("seq"), raw.alias("raw_id"))
    x = x.withColumn("view_id", normalize_view_id(F.col("raw_id")))
    return x.withColumn("known", F.col("view_id").isin(*known))


def completion_errors(spark, d):
    """L2: the closing chunk of failed completions, one per failed task event."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "props")
    k = F.get_json_object("props", "$.k").cast("long")
    models = F.create_map(*[F.lit(x) for v in view_specs(spark) for x in (v["id"], v["model"])])
    x = e.where(F.col("event_type") == "error").select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"),
        F.element_at(F.array(*[F.lit(v) for v in TASK_VIEWS]),
                     (F.pmod(k, F.lit(len(TASK_VIEWS))) + 1).cast("int")).alias("view_id"),
        F.element_at(F.array(*[F.lit(v) for v in ERROR_KINDS]),
                     (F.pmod(k, F.lit(len(ERROR_KINDS))) + 1).cast("int")).alias("error_kind"),
        F.concat(F.lit("request failed for item "), k.cast("string")).alias("error"))
    x = x.withColumn("model", task_model(models[F.col("view_id")]))
    return x.select("session_id", "seq", "view_id", "model", "error_kind",
                    error_content(F.col("error_kind"), F.col("model"), F.col("error")).alias("content"))


# --- fixed values: the default settings layer (section, key, value) ------------
DEFAULT_SETTINGS = [
    ("settings", "default_view", "terminal"), ("settings", "max_history", "50"),
    ("settings", "stream_delay", "0.01"), ("settings", "app_title", "Web views"),
    ("ai", "default_model", DEFAULT_MODEL), ("ui", "show_icons", "true"),
    ("ui", "compact_mode", "false"),
]


def settings_overlay_q(spark, d):
    """B6 per session: defaults, overridden where the session's data sets a key.

    The override layer: a session's last activated known view becomes its
    ``settings.default_view``.
    """
    last = (_tab_events(spark, d).where("known").groupBy("session_id")
            .agg(F.max_by("view_id", F.struct("ts", "seq")).alias("value")))
    override = last.select("session_id", F.lit("settings").alias("section"),
                           F.lit("default_view").alias("key"), "value")
    sessions = table(spark, d, "events", "user_id").select(F.col("user_id").alias("session_id")).distinct()
    defaults = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(k).alias("key"), F.lit(v).alias("value"))
                         for s, k, v in DEFAULT_SETTINGS])
    base = sessions.select("session_id", F.explode(defaults).alias("d")).select(
        "session_id", "d.section", "d.key", "d.value")
    return settings_overlay(base, override, ["session_id"])


def _chunks(spark, d) -> DataFrame:
    c = table(spark, d, "conversations", "conv_id", "turn", "role", "text")
    return c.select("conv_id", F.col("turn").alias("seq"), "role", F.col("text").alias("chunk"))


def chunk_filter(spark, d):
    return C.drop_empty(_chunks(spark, d)).select("conv_id", "seq", "chunk")


def response_text(spark, d):
    c = C.drop_empty(_chunks(spark, d))
    return c.groupBy("conv_id").agg(
        ordered_join("chunk", ["seq"]).alias("response"),
        F.count(F.lit(1)).cast("long").alias("n_chunks"))


def response_lines(spark, d):
    return C.response_lines(_chunks(spark, d), ["conv_id"]).select("conv_id", "line_no", "line")


def snapshots(spark, d):
    return C.snapshots(_chunks(spark, d), ["conv_id"], SNAPSHOT_EVERY)


def snapshot_offsets(spark, d):
    """H3 as stored: where each snapshot ends in its response."""
    return C.snapshot_offsets(C.response_lines(_chunks(spark, d), ["conv_id"]), ["conv_id"], SNAPSHOT_EVERY)


def response_log(spark, d):
    c = C.drop_empty(_chunks(spark, d))
    g = c.groupBy("conv_id").agg(
        ordered_join("chunk", ["seq"], "\n\n", F.col("role") == "user").alias("prompt"),
        ordered_join("chunk", ["seq"], "", F.col("role") != "user").alias("response"))
    return g.where(F.col("response").isNotNull() & (F.col("response") != ""))


def view_content_latest(spark, d):
    c = _chunks(spark, d)
    return c.groupBy("conv_id", "role").agg(
        F.max("seq").alias("seq"), F.max_by("chunk", F.col("seq")).alias("content"))


QUERIES = {
    "nav_dedup": nav_dedup,
    "nav_last_n": nav_last_n,
    "nav_history": nav_history,
    "current_page": current_page,
    "task_status": task_status,
    "task_totals": task_totals,
    "on_demand_tasks": on_demand_tasks,
    "view_events": view_events,
    "completion_errors": completion_errors,
    "settings_overlay": settings_overlay_q,
    "chunk_filter": chunk_filter,
    "response_text": response_text,
    "response_lines": response_lines,
    "snapshots": snapshots,
    "snapshot_offsets": snapshot_offsets,
    "response_log": response_log,
    "view_content_latest": view_content_latest,
}


# --- oracle -------------------------------------------------------------------

_NAV = (f"nav AS (SELECT user_id AS session_id, ts, event_id AS seq, "
        f"CASE WHEN event_type = 'signup' THEN 'back' ELSE 'visit' END AS op, "
        f"{lit(NAV_URL_PREFIX)} || json_extract_string(props, '$.k') AS url, "
        f"event_type <> 'error' AS ok FROM events)")
_DEDUP = (_NAV + ", v AS (SELECT *, lag(url) OVER (PARTITION BY session_id ORDER BY ts, seq) AS prev_url "
          "FROM nav WHERE op = 'visit'), dd AS (SELECT * FROM v WHERE url IS DISTINCT FROM prev_url)")
_ev_case = " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in TASK_EVENTS.items())
_views_list = "[" + ", ".join(lit(v) for v in TASK_VIEWS) + "]"
_TASKS = (f"te AS (SELECT user_id AS session_id, ts, event_id AS seq, CASE event_type {_ev_case} END AS event, "
          f"{_views_list}[((json_extract_string(props, '$.k')::BIGINT % {len(TASK_VIEWS)}) + "
          f"{len(TASK_VIEWS)}) % {len(TASK_VIEWS)} + 1] AS view_id FROM events "
          f"WHERE event_type IN ({', '.join(lit(x) for x in TASK_EVENTS)})), "
          "ln AS (SELECT session_id, max({'ts': ts, 'seq': seq}) AS nav_at FROM te "
          "WHERE event = 'navigate' GROUP BY session_id), "
          "ts1 AS (SELECT te.* FROM te LEFT JOIN ln USING (session_id) WHERE te.event <> 'navigate' "
          "AND (nav_at IS NULL OR te.ts > nav_at.ts OR (te.ts = nav_at.ts AND te.seq > nav_at.seq))), "
          "st AS (SELECT session_id, view_id, CASE WHEN arg_max(event, {'ts': ts, 'seq': seq}) = 'loading' "
          "THEN 'loading' ELSE 'loaded' END AS status FROM ts1 GROUP BY session_id, view_id)")
_names = " ".join(f"WHEN {lit(v[0])} THEN {lit(v[1])}" for v in DEFAULT_VIEWS)
_lazy = ", ".join(f"({lit(v[0])})" for v in DEFAULT_VIEWS if not v[5])
_CH = ("ch AS (SELECT conv_id, turn AS seq, role, text AS chunk FROM conversations), "
       "chn AS (SELECT * FROM ch WHERE chunk IS NOT NULL AND chunk <> '')")
_LINES = (_CH + ", fulltext AS (SELECT conv_id, string_agg(chunk, '' ORDER BY seq) AS s FROM chn GROUP BY conv_id), "
          "lx AS (SELECT conv_id, regexp_extract_all(s, '[^\\n]*\\n|[^\\n]+', 0) AS ls FROM fulltext), "
          "lines AS (SELECT conv_id, unnest(range(len(ls)))::BIGINT AS line_no, unnest(ls) AS line FROM lx)")

#: the history after each event, as a list; row 0 is a session's empty history
_FOLD = f"""{_NAV},
ev AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, seq) AS rn, op, url, ok, seq FROM nav),
fold(session_id, rn, stack) AS (
  SELECT DISTINCT session_id, 0::BIGINT, []::VARCHAR[] FROM ev
  UNION ALL
  SELECT f.session_id, f.rn + 1,
    CASE WHEN e.op = 'back' THEN (CASE WHEN len(f.stack) >= 2 THEN f.stack[:-2] ELSE f.stack END)
         WHEN len(f.stack) > 0 AND f.stack[-1] = e.url THEN f.stack
         ELSE (list_append(f.stack, e.url))[greatest(len(f.stack) + 1 - {HISTORY_CAP - 1}, 1):] END
  FROM fold f JOIN ev e ON e.session_id = f.session_id AND e.rn = f.rn + 1)"""

ORACLE = {
    "nav_dedup": f"WITH {_DEDUP} SELECT session_id, seq, url FROM dd",
    "nav_last_n": f"WITH {_DEDUP}, r AS (SELECT session_id, seq, url, row_number() OVER "
                  f"(PARTITION BY session_id ORDER BY ts DESC, seq DESC)::BIGINT AS from_end FROM dd) "
                  f"SELECT * FROM r WHERE from_end <= {HISTORY_CAP}",
    "nav_history": f"""WITH RECURSIVE {_FOLD},
fin AS (SELECT session_id, arg_max(stack, rn) AS stack FROM fold GROUP BY session_id)
SELECT session_id, unnest(range(len(stack)))::BIGINT AS pos, unnest(stack) AS url FROM fin""",
    "current_page": f"""WITH RECURSIVE {_FOLD},
shown AS (
  SELECT e.session_id, e.rn, CASE WHEN e.op = 'visit' AND e.ok THEN e.url
    WHEN e.op = 'back' AND e.ok AND len(p.stack) >= 2 THEN f.stack[-1] END AS url, e.seq
  FROM ev e JOIN fold f ON f.session_id = e.session_id AND f.rn = e.rn JOIN fold p ON p.session_id = e.session_id AND p.rn = e.rn - 1)
SELECT session_id, seq, last_value(url IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY rn
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current_url FROM shown""",
    "task_status": f"WITH {_TASKS} SELECT session_id, view_id, status, CASE status WHEN 'loading' "
                   f"THEN '⏳ ' || (CASE view_id {_names} END) ELSE '✓ ' || (CASE view_id {_names} END) "
                   f"END AS label FROM st",
    "task_totals": f"WITH {_TASKS} SELECT session_id, count(*) FILTER (WHERE status = 'loaded')::BIGINT "
                   f"AS n_loaded, count(*) FILTER (WHERE status = 'loading')::BIGINT AS n_loading "
                   f"FROM st GROUP BY session_id",
    "on_demand_tasks": f"WITH {_TASKS} SELECT s.session_id, l.view_id FROM "
                       f"(SELECT DISTINCT session_id FROM te WHERE event = 'navigate') s "
                       f"CROSS JOIN (VALUES {_lazy}) l(view_id) "
                       f"WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.session_id = s.session_id "
                       f"AND st.view_id = l.view_id)",
    "chunk_filter": f"WITH {_CH} SELECT conv_id, seq, chunk FROM chn",
    "response_text": f"WITH {_CH} SELECT conv_id, string_agg(chunk, '' ORDER BY seq) AS response, "
                     f"count(*)::BIGINT AS n_chunks FROM chn GROUP BY conv_id",
    "response_lines": f"WITH {_LINES} SELECT conv_id, line_no, line FROM lines",
    "snapshots": f"WITH {_LINES}, s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id "
                 f"ORDER BY line_no)::BIGINT AS n_lines, count(*) OVER (PARTITION BY conv_id) AS last_n, "
                 f"string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY line_no ROWS BETWEEN "
                 f"UNBOUNDED PRECEDING AND CURRENT ROW) AS content FROM lines) "
                 f"SELECT conv_id, n_lines, content FROM s WHERE n_lines % {SNAPSHOT_EVERY} = 0 "
                 f"OR n_lines = last_n",
    "snapshot_offsets": f"""WITH {_LINES}, s AS (
SELECT conv_id, line_no + 1 AS n_lines, max(line_no) OVER (PARTITION BY conv_id) + 1 AS last_n,
  CAST(sum(length(line)) OVER (PARTITION BY conv_id ORDER BY line_no) AS BIGINT) AS "end" FROM lines)
SELECT conv_id, n_lines, "end" FROM s WHERE n_lines % {SNAPSHOT_EVERY} = 0 OR n_lines = last_n""",
    "response_log": f"WITH {_CH}, g AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN chunk END, "
                    f"chr(10) || chr(10) ORDER BY seq) AS prompt, string_agg(CASE WHEN role <> 'user' "
                    f"THEN chunk END, '' ORDER BY seq) AS response FROM chn GROUP BY conv_id) "
                    f"SELECT * FROM g WHERE response IS NOT NULL AND response <> ''",
    "view_content_latest": f"WITH {_CH} SELECT conv_id, role, max(seq) AS seq, arg_max(chunk, seq) "
                           f"AS content FROM ch GROUP BY conv_id, role",
}

_tabs = "[" + ", ".join(lit(v) for v in TAB_IDS) + "]"
_tk = "json_extract_string(props, '$.k')::BIGINT"
_known = ", ".join(lit(v[0]) for v in DEFAULT_VIEWS)
_tab_pick = f"{_tabs}[({_tk} % {len(TAB_IDS)}) + 1]"
_raw_id = (f"CASE WHEN ((({_tk}) // {len(TAB_IDS)}) % 2) = 0 THEN {lit(VIEW_ID_PREFIX)} || "
           f"{_tab_pick} ELSE {_tab_pick} END")
ORACLE["view_events"] = (
    f"WITH x AS (SELECT user_id AS session_id, ts, event_id AS seq, {_raw_id} AS raw_id FROM events "
    f"WHERE event_type = 'click'), y AS (SELECT *, CASE WHEN starts_with(raw_id, {lit(VIEW_ID_PREFIX)}) "
    f"THEN substr(raw_id, {len(VIEW_ID_PREFIX) + 1}) ELSE raw_id END AS view_id FROM x) "
    f"SELECT * EXCLUDE (ts), view_id IN ({_known}) AS known FROM y")

_model_case = " ".join(
    f"WHEN {lit(v[0])} THEN {lit(v[9].strip() or DEFAULT_MODEL)}" for v in DEFAULT_VIEWS)
_kinds = "[" + ", ".join(lit(v) for v in ERROR_KINDS) + "]"
_AUTH_SQL = ("'## 🔐 Authentication Error' || chr(10) || chr(10) || 'Authentication failed for model ' "
             "|| chr(39) || model || chr(39) || '. Please set a valid API key for ' "
             "|| split_part(model, '/', 1) || '.'")
ORACLE["completion_errors"] = (
    f"WITH x AS (SELECT user_id AS session_id, event_id AS seq, "
    f"{_views_list}[({_tk} % {len(TASK_VIEWS)}) + 1] AS view_id, "
    f"{_kinds}[({_tk} % {len(ERROR_KINDS)}) + 1] AS error_kind, "
    f"'request failed for item ' || ({_tk})::VARCHAR AS error FROM events WHERE event_type = 'error'), "
    f"y AS (SELECT *, CASE view_id {_model_case} END AS model FROM x) "
    f"SELECT session_id, seq, view_id, model, error_kind, CASE error_kind "
    f"WHEN 'auth' THEN {_AUTH_SQL} "
    f"WHEN 'runtime' THEN '## ❌ Error' || chr(10) || chr(10) || error "
    f"ELSE '## ❌ Unexpected Error' || chr(10) || chr(10) || error END AS content FROM y")

_defaults_sql = ", ".join(f"({lit(s)}, {lit(k)}, {lit(v)})" for s, k, v in DEFAULT_SETTINGS)
ORACLE["settings_overlay"] = (
    f"WITH ve AS ({ORACLE['view_events'].replace('* EXCLUDE (ts)', '*')}), "
    f"lastv AS (SELECT session_id, arg_max(view_id, {{'ts': ts, 'seq': seq}}) AS value FROM ve WHERE known GROUP BY session_id), "
    f"s AS (SELECT DISTINCT user_id AS session_id FROM events), "
    f"base AS (SELECT s.session_id, d.section, d.key, d.value FROM s, "
    f"(VALUES {_defaults_sql}) d(section, key, value)), "
    f"ovr AS (SELECT session_id, 'settings' AS section, 'default_view' AS key, value FROM lastv) "
    f"SELECT b.session_id, b.section, b.key, coalesce(o.value, b.value) AS value "
    f"FROM base b LEFT JOIN ovr o USING (session_id, section, key)")
