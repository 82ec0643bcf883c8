"""Registered queries for views and tasks per page."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import (
    DEFAULT_MAX_TOKENS,
    DEFAULT_MODEL,
    DEFAULT_TEMPERATURE,
    MODEL_INPUT_CHARS,
    NO_CLIENT_NOTICE,
)
from ..functions.sqltext import lit
from ..operators import markdown as M
from ..operators import views as V
from ..session import checkpoint_dir
from ..sources.tables import pages
from . import render as R

# --- fixed values: one prompt override (B9) ------------------------------------
PROMPT_OVERRIDES = [("summary", "Summarise this page in one sentence.")]


def loaded_pages(spark, d) -> DataFrame:
    """Pages that loaded (A3): HTML present and non-empty."""
    p = pages(spark, d, "page_id", "url", "html")
    return p.where(F.col("html").isNotNull() & (F.col("html") != "")).select("page_id", "url")


def eager_tasks(spark, d):
    """Every loaded page x every enabled auto-load view (config array, exploded)."""
    specs = [v for v in V.view_specs(spark) if v["auto_load"]]
    return V.fan_out(loaded_pages(spark, d).select("page_id"), specs,
                     {"view_id": "id", "view_order": "order"})


def _clean_for_model(spark, d, max_chars: int | None = MODEL_INPUT_CHARS) -> DataFrame:
    """D2 once per page, up to ``max_chars`` characters (D5; None: whole)."""
    r = R.rendered(spark, d, "clean", max_chars)
    return r.select("page_id", "url",
                    F.concat(M.clean_header(F.col("title"), F.col("url")), F.col("md")).alias("clean"))


def _model_views(spark, overrides=None) -> list[dict]:
    """Model views (not ``raw``) of the catalogue; with ``overrides`` (B9) only the
    views whose prompt was edited, carrying the new prompt."""
    specs = [v.asDict() for v in V.view_specs(spark) if v["id"] != "raw"]
    if overrides is None:
        return specs
    new = dict(overrides)
    return [{**v, "prompt": new[v["id"]]} for v in specs if v["id"] in new]


def prompts(spark, d, session_model: str | None = None, eager_only: bool = True,
            max_chars: int | None = MODEL_INPUT_CHARS) -> DataFrame:
    """Prompt and model for each model view of each page, of the eager ones or of all.

    The clean text is computed once per page, then fanned out over the views
    (config array, exploded), not recomputed per view.  ``max_chars`` limits what a
    model is sent of a page (D5); None sends it whole.
    """
    specs = [v for v in _model_views(spark) if v["auto_load"] or not eager_only]
    t = V.fan_out(_clean_for_model(spark, d, max_chars), specs,
                  {"view_id": "id", "prompt": "prompt", "model": "model"})
    return t.select("page_id", "view_id",
                    V.task_model(F.col("model"), session_model).alias("model"),
                    V.prompt_text(F.col("prompt"), F.col("clean")).alias("prompt"))


def view_prompts(spark, d):
    return prompts(spark, d)


def task_model(spark, d):
    """B10 for every enabled view of every loaded page (eager and on demand)."""
    t = V.fan_out(loaded_pages(spark, d).select("page_id"), V.view_specs(spark),
                  {"view_id": "id", "model": "model"})
    return t.select("page_id", "view_id", V.task_model(F.col("model")).alias("model"))


def chat_requests(spark, d):
    """The request each model task sends, flattened to columns."""
    p = view_prompts(spark, d)
    req = V.chat_request(F.col("model"), F.col("prompt"))
    x = p.select("page_id", "view_id", req.alias("r"))
    return x.select("page_id", "view_id", "r.model", F.col("r.messages")[0]["role"].alias("role"),
                    F.col("r.messages")[0]["content"].alias("content"), "r.temperature",
                    F.col("r.max_tokens").cast("long").alias("max_tokens"), "r.stream")


# --- fixed values: option layers by page_id: what a call and a client set ----------------
CALL_OPTIONS = (2, '{"temperature": 0.9, "max_tokens": 100}')
CLIENT_OPTIONS = (3, '{"max_tokens": 2048, "top_p": 0.5, "stop": ["\\n\\n", null], "api_key": "none"}')


def request_sink(spark, d):
    """Requests written as JSON lines, options in layers, and read back."""
    p = view_prompts(spark, d)
    call, client = (F.when(F.pmod(F.col("page_id"), F.lit(n)) == 0, F.lit(options)) for n, options in (CALL_OPTIONS, CLIENT_OPTIONS))
    path = f"{checkpoint_dir(spark).rstrip('/')}/requests-{uuid.uuid4().hex}"
    p.select("page_id", "view_id", V.request_json(F.col("model"), F.col("prompt"), None, call, client).alias("request")).write.json(path)
    sent = spark.read.schema("page_id long, view_id string, request string").json(path)
    r, v = V.read_request(F.col("request")), F.parse_json("request")
    return sent.select("page_id", "view_id", r.alias("r"), F.variant_get(v, "$.top_p", "double").alias("top_p"),
                       F.variant_get(v, "$.stop[0]", "string").alias("stop"), F.col("request").contains("api_key").alias("has_key")).select(
        "page_id", "view_id", "r.model", F.col("r.messages")[0]["role"].alias("role"), F.col("r.messages")[0]["content"].alias("content"),
        "r.temperature", F.col("r.max_tokens").cast("long").alias("max_tokens"), "r.stream", "top_p", "stop", "has_key")


def view_outputs(spark, d):
    """F2/L3: route eager tasks by view id: ``raw`` renders markdown, the others
    need a completion function; with none configured they get the notice."""
    r = R.rendered(spark, d, "raw")
    raw = F.struct(F.lit("raw").alias("view_id"), F.lit("loaded").alias("status"),
                   F.concat(M.raw_header(F.col("title"), F.col("url")), F.col("md")).alias("content"))
    specs = [v for v in _model_views(spark) if v["auto_load"]]
    others = [F.when(F.col("loaded"), F.struct(F.lit(v["id"]).alias("view_id"),
                                               F.lit("unavailable").alias("status"),
                                               F.lit(NO_CLIENT_NOTICE).alias("content")))
              for v in specs]
    # One pass over the rendered pages: each emits its raw row and, when it
    # loaded, one notice row per eager model view.
    rows = F.filter(F.array(raw, *others), lambda x: x.isNotNull())
    out = r.select("page_id", F.explode(rows).alias("o"))
    return out.select("page_id", "o.view_id", "o.status", "o.content")


def prompt_override(spark, d):
    """After a prompt edit, only the edited views are recomputed, on loaded pages."""
    specs = _model_views(spark, PROMPT_OVERRIDES)
    t = V.fan_out(_clean_for_model(spark, d), specs, {"view_id": "id", "prompt": "prompt"})
    return t.select("page_id", "view_id", V.prompt_text(F.col("prompt"), F.col("clean")).alias("prompt"))


QUERIES = {
    "eager_tasks": eager_tasks,
    "view_prompts": view_prompts,
    "task_model": task_model,
    "chat_requests": chat_requests,
    "request_sink": request_sink,
    "view_outputs": view_outputs,
    "prompt_override": prompt_override,
}


# --- oracle -------------------------------------------------------------------

def _views_sql() -> str:
    """The validated, enabled catalogue as a VALUES list (configuration)."""
    rows = []
    for (vid, name, hotkey, order, enabled, auto, _d, _i, prompt, model, pos) in V.DEFAULT_VIEWS:
        if enabled and len(hotkey) == 1:
            rows.append(f"({lit(vid)}, {lit(name)}, {int(order)}, {str(auto).upper()}, "
                        f"{lit(prompt)}, {lit(model)})")
    return f"(VALUES {', '.join(rows)}) vw(view_id, name, view_order, auto_load, prompt, model)"


def _model_sql(m: str) -> str:
    return f"coalesce(nullif(trim({m}), ''), {lit(DEFAULT_MODEL)})"


def _clean_ctes() -> str:
    return R.render_ctes("clean", MODEL_INPUT_CHARS) + (
        f",\ncl AS (SELECT page_id, url, {M.clean_header_sql('title', 'url')} || md AS clean "
        f"FROM rendered_clean)")


_PROMPT = "coalesce(prompt, '') || chr(10) || chr(10) || 'Webpage content:' || chr(10) || clean"
_LOADED = "(SELECT page_id, url FROM pages WHERE html IS NOT NULL AND html <> '')"
_ovr = ", ".join(f"({lit(a)}, {lit(b)})" for a, b in PROMPT_OVERRIDES)



def prompts_sql(eager_only: bool = True) -> str:
    eager = "vw.auto_load AND " if eager_only else ""
    return (f"WITH {_clean_ctes()} SELECT page_id, view_id, {_model_sql('model')} AS model, "
            f"{_PROMPT} AS prompt FROM cl, {_views_sql()} WHERE {eager}view_id <> 'raw'")


ORACLE = {
    "eager_tasks": f"SELECT p.page_id, vw.view_id, vw.view_order FROM {_LOADED} p, {_views_sql()} "
                   f"WHERE vw.auto_load",
    "view_prompts": prompts_sql(),
    "task_model": f"SELECT p.page_id, vw.view_id, {_model_sql('vw.model')} AS model "
                  f"FROM {_LOADED} p, {_views_sql()}",
    "chat_requests": f"WITH {_clean_ctes()} SELECT page_id, view_id, {_model_sql('model')} AS model, "
                     f"'user' AS role, {_PROMPT} AS content, {DEFAULT_TEMPERATURE}::DOUBLE AS temperature, "
                     f"{DEFAULT_MAX_TOKENS}::BIGINT AS max_tokens, true AS stream "
                     f"FROM cl, {_views_sql()} WHERE vw.auto_load AND view_id <> 'raw'",
    "request_sink": f"SELECT page_id, view_id, model, 'user' AS role, prompt AS content, CASE WHEN page_id % {CALL_OPTIONS[0]} = 0 THEN 0.9::DOUBLE ELSE {DEFAULT_TEMPERATURE}::DOUBLE END AS temperature, "
                    f"CASE WHEN page_id % {CLIENT_OPTIONS[0]} = 0 THEN 2048 WHEN page_id % {CALL_OPTIONS[0]} = 0 THEN 100 ELSE {DEFAULT_MAX_TOKENS} END::BIGINT AS max_tokens, true AS stream, "
                    f"CASE WHEN page_id % {CLIENT_OPTIONS[0]} = 0 THEN 0.5::DOUBLE END AS top_p, CASE WHEN page_id % {CLIENT_OPTIONS[0]} = 0 THEN chr(10) || chr(10) END AS stop, "
                    f"false AS has_key FROM ({prompts_sql()})",
    "view_outputs": f"WITH {R.render_ctes('raw')} SELECT page_id, 'raw' AS view_id, 'loaded' AS status, "
                    f"{M.raw_header_sql('title', 'url')} || md AS content FROM rendered_raw "
                    f"UNION ALL SELECT p.page_id, vw.view_id, 'unavailable', {lit(NO_CLIENT_NOTICE)} "
                    f"FROM {_LOADED} p, {_views_sql()} WHERE vw.auto_load AND vw.view_id <> 'raw'",
    "prompt_override": f"WITH {_clean_ctes()}, o(view_id, prompt) AS (VALUES {_ovr}) "
                       f"SELECT page_id, o.view_id, {_PROMPT} AS prompt FROM cl, o "
                       f"WHERE o.view_id IN (SELECT view_id FROM {_views_sql()} WHERE view_id <> 'raw')",
}
