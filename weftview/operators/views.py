"""View catalogue and task fan-out.

The catalogue is configuration: a handful of rows, validated as a DataFrame and then carried as a literal array
inside the page-side expressions, so fanning pages out over views needs no
join; its size is bounded by the config, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import DEFAULT_MAX_TOKENS, DEFAULT_MODEL, DEFAULT_TEMPERATURE
from ..functions.text import trim_ws

RAW_VIEW_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("hotkey", T.StringType()), T.StructField("order", T.StringType()),
    T.StructField("enabled", T.BooleanType()), T.StructField("auto_load", T.BooleanType()),
    T.StructField("description", T.StringType()), T.StructField("icon", T.StringType()),
    T.StructField("prompt", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("input_pos", T.IntegerType()),
])

# --- fixed values: the view catalogue (ids, names, hotkeys, order, eagerness) --
# Two built-in views plus three on-demand ones; ``order`` is text in one row
# to exercise lax coercion.  Prompts are this project's own wording.
DEFAULT_VIEWS = [
    ("raw", "Raw View", "1", "1", True, True, "Clean HTML rendering (no model)", "📄", "", "", 0),
    ("terminal", "Terminal", "2", "2", True, True,
     "Terminal-optimised markdown", "💻",
     "Rewrite this page as compact markdown for reading in a terminal.", "", 1),
    ("summary", "Summary", "3", "3", True, False, "Short summary", "📋",
     "Summarise this page in a few bullet points.", "gpt-4o-mini", 2),
    ("eli5", "ELI5", "4", "4", True, False, "Simple explanation", "🎉",
     "Explain this page in very simple words.", "", 3),
    ("recipe", "Recipe", "5", "5", True, False, "Recipe card", "🍳",
     "List only the ingredients and steps of the recipe on this page.", "", 4),
]
VIEW_ID_PREFIX = "--content-tab-"


def catalog(spark: SparkSession, rows=None) -> DataFrame:
    """View rows as configured (unvalidated, ``order`` as text)."""
    return spark.createDataFrame(rows if rows is not None else DEFAULT_VIEWS, RAW_VIEW_SCHEMA)


def validate(views: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows with ``order`` INT, quarantined rows with ``reason``).

    A hotkey must be exactly one character; ``order`` is coerced leniently
    (``"5"`` -> 5, surrounding spaces allowed); a value that is not an integer
    quarantines the row.  Other rows are unaffected.
    """
    order = F.expr("try_cast(trim(`order`) AS INT)")
    v = views.withColumn("_order", F.when(F.col("order").isNull(), F.lit(0)).otherwise(order))
    reason = (F.when(F.col("hotkey").isNull() | (F.length("hotkey") != 1),
                     F.lit("Hotkey must be a single character"))
              .when(F.col("_order").isNull(), F.lit("order is not an integer")))
    v = v.withColumn("reason", reason)
    good = v.where(F.col("reason").isNull()).withColumn("order", F.col("_order")).drop("_order", "reason")
    bad = v.where(F.col("reason").isNotNull()).drop("_order")
    return good, bad


def enabled_views(valid: DataFrame) -> DataFrame:
    """Enabled views, one per id (the later row wins), in display order."""
    e = valid.where(F.col("enabled"))
    w = Window.partitionBy("id").orderBy(F.col("input_pos").desc())
    return e.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def views_ready(spark: SparkSession, rows=None) -> DataFrame:
    good, _ = validate(catalog(spark, rows))
    return enabled_views(good)


def task_model(view_model: Column, session_override: str | None = None,
               default_model: str = DEFAULT_MODEL) -> Column:
    """Session override > the view's own model (trimmed, non-blank) > default."""
    m = trim_ws(view_model)
    chosen = F.coalesce(F.when(m != "", m), F.lit(default_model))
    return F.lit(session_override) if session_override else chosen


def prompt_text(prompt: Column, clean: Column) -> Column:
    """``prompt``, blank line, ``Webpage content:``, then the clean text."""
    return F.concat(F.coalesce(prompt, F.lit("")), F.lit("\n\nWebpage content:\n"), clean)


def user_content(prompt: Column, content: Column) -> Column:
    """Prompt + blank line + content, or the prompt alone when content is empty."""
    return F.when(F.coalesce(content, F.lit("")) == "", prompt).otherwise(
        F.concat(prompt, F.lit("\n\n"), content))


def chat_request(model: Column, prompt: Column, content: Column = None,
                 temperature: float = DEFAULT_TEMPERATURE, max_tokens: int = DEFAULT_MAX_TOKENS,
                 options: Column | None = None) -> Column:
    """The request struct; keys in ``options`` (a MAP) override the defaults.

    Precedence is per key (``coalesce(options[key], default)``), so no map with
    duplicate keys is ever built.
    """
    def opt(key: str, default) -> Column:
        d = F.lit(str(default))
        return F.coalesce(options[key], d) if options is not None else d

    msg = F.struct(F.lit("user").alias("role"),
                   user_content(prompt, content if content is not None else F.lit("")).alias("content"))
    return F.struct(model.alias("model"), F.array(msg).alias("messages"),
                    opt("temperature", temperature).cast("double").alias("temperature"),
                    opt("max_tokens", max_tokens).cast("int").alias("max_tokens"),
                    F.lit(True).alias("stream"))


OPTIONS = "map<string,variant>"
SECRET_KEYS = ("api_key",)


def merged_options(*layers: Column) -> Column:
    """Option layers, JSON objects as text, merged key by key: the later layer that has the key wins.

    Values keep their JSON types, nested ones as wholes; a key set to null is set.  A layer that is
    NULL, empty or no JSON object has no keys.  Secrets never become data: their keys are left out.
    """
    maps = [F.coalesce(F.from_json(x, OPTIONS), F.expr(f"cast(map() as {OPTIONS})")) for x in layers]
    out = maps[0]
    for m in maps[1:]:
        out = F.map_zip_with(out, m, lambda k, a, b: F.coalesce(b, a))
    return F.map_filter(out, lambda k, v: ~k.isin(*SECRET_KEYS))


def request_json(model: Column, prompt: Column, content: Column | None = None, *layers: Column,
                 temperature: float = DEFAULT_TEMPERATURE, max_tokens: int = DEFAULT_MAX_TOKENS) -> Column:
    """The request as JSON text, as it is sent and logged.

    Lowest layer: the request with its default options; then ``layers`` in order, as a client
    has them: the call's options, the endpoint, the client's own options.
    """
    base = chat_request(model, prompt, content, temperature, max_tokens)
    return F.to_json(merged_options(F.to_json(base), *layers))


REQUEST_SCHEMA = ("model string, messages array<struct<role: string, content: string>>, temperature double, "
                  "max_tokens int, stream boolean")


def read_request(request: Column) -> Column:
    """The typed request of its JSON text."""
    return F.from_json(request, REQUEST_SCHEMA)


def status_label(status: Column, name: Column) -> Column:
    """``⏳ name`` while loading, ``✓ name`` when loaded, else the plain name."""
    return (F.when(status == "loading", F.concat(F.lit("⏳ "), name))
            .when(status == "loaded", F.concat(F.lit("✓ "), name)).otherwise(name))


def normalize_view_id(raw_id: Column) -> Column:
    """Strip the tab prefix the UI adds to view ids."""
    return F.when(raw_id.startswith(VIEW_ID_PREFIX),
                  F.substr(raw_id, F.lit(len(VIEW_ID_PREFIX) + 1))).otherwise(raw_id)


def error_content(kind: Column, model: Column, error: Column) -> Column:
    """L2: the chunk a failed completion ends with."""
    provider = F.substring_index(model, "/", 1)
    auth = F.concat(F.lit("## 🔐 Authentication Error\n\nAuthentication failed for model '"), model,
                    F.lit("'. Please set a valid API key for "), provider, F.lit("."))
    return (F.when(kind == "auth", auth)
            .when(kind == "runtime", F.concat(F.lit("## ❌ Error\n\n"), error))
            .otherwise(F.concat(F.lit("## ❌ Unexpected Error\n\n"), error)))


_DEFAULT_SPECS: list = []


def view_specs(spark: SparkSession, rows=None) -> list:
    """The validated, enabled catalogue as driver-side rows (configuration).

    The default catalogue is fixed, so its validation runs once per process.
    """
    if rows is None and _DEFAULT_SPECS:
        return list(_DEFAULT_SPECS)
    specs = views_ready(spark, rows).orderBy("order", "input_pos").collect()
    if rows is None:
        _DEFAULT_SPECS[:] = specs
    return specs


def fan_out(df: DataFrame, specs, fields: dict[str, str]) -> DataFrame:
    """one row per input row and view, by exploding a literal array of the views.

    ``fields`` maps output column -> catalogue field.  No join is planned: the
    views travel inside the expression, so each input row fans out in place.
    """
    if not specs:
        return df.where(F.lit(False)).select(
            "*", *[F.lit(None).cast("string").alias(c) for c in fields])
    arr = F.array(*[F.struct(*[F.lit(r[f]).alias(c) for c, f in fields.items()]) for r in specs])
    return df.select("*", F.explode(arr).alias("_v")).select(
        *[c for c in df.columns], *[F.col(f"_v.{c}").alias(c) for c in fields])


def settings_overlay(base: DataFrame, override: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Layered settings ``(keys..., section, key, value)``: an override beats the
    default per key, keys only in one layer stay.  ``keys`` scope the layers
    (e.g. a session); each scope has a handful of rows, so no key is hot."""
    on = [*(keys or []), "section", "key"]
    b = base.select(*on, F.col("value").alias("_b"))
    o = override.select(*on, F.col("value").alias("_o"))
    return b.join(o, on, "full_outer").select(*on, F.coalesce("_o", "_b").alias("value"))


def views_overlay(default_views: DataFrame, override_views: DataFrame) -> DataFrame:
    """A non-empty override view list replaces the defaults entirely."""
    some = override_views.limit(1).select(F.lit(True).alias("_some"))
    return override_views.unionByName(default_views.join(some, F.lit(True), "left_anti"))


def focus_links(links: DataFrame, focus: DataFrame, keys: list[str]) -> DataFrame:
    """Links apply only for the view in focus (``focus(keys..., view_id)``);
    the selection restarts at -1."""
    return (links.join(focus.select(*keys, "view_id"), [*keys, "view_id"], "left_semi")
            .withColumn("selected_idx", F.lit(-1).cast("long")))
