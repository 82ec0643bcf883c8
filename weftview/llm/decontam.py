"""Benchmark decontamination by template canonicalisation, in DataFrame functions alone.

A text's canonical tokens: numbers (in digits, also with a unit right behind them, or as words), units behind a number and names (capitalised words inside a
sentence) become typed slots `<num:..>`, `<unit:..>`, `<name:..>` that remember their value; the
rest is lower-cased and punctuation dropped.  A template is a window of WINDOW tokens with the
values left out.  Names are known by their case only, so there is a second
template of each window with names as plain tokens, and an item's name may stand for any one word.
The benchmark items' windows meet the documents' windows at every token, so that
any WINDOW shared tokens are found.  Items look for documents by their windows of at least
LITERALS plain tokens; an item that has none in a template (it is shorter or mostly slots) by one window, as
long as the item or WINDOW, and then all its tokens must be there.  Of other items nearly all
tokens must be there if they are short, and over half if they are long (`need`): in their places
on one alignment, or in the windows found on near alignments together.  The slots must be consistent:
each of the item's values stands for one value in the document, as in a question with new
parameters.

Null and empty texts and items match nothing.  Items with fewer than LITERALS plain tokens must
have their own values in the document, and items of fewer than LITERALS tokens be its whole text
(they name no question).  Rows without a doc_id or item_id are left out; repeated rows count once;
extra columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, small

WINDOW = 6
LITERALS = 3

# Unit words that follow a number.
UNITS = ("percent|mg|g|kg|t|lb|lbs|oz|mm|cm|m|km|ft|feet|foot|inch|inches|mile|miles|yard|yards|ms|s|sec|second|seconds|min|minute|"
         "minutes|h|hr|hrs|hour|hours|day|days|week|weeks|month|months|year|years|ml|l|liter|liters|litre|litres|w|kw|mw|v|a|hz|khz|mhz|"
         "ghz|b|kb|mb|gb|tb|mph|kmh|usd|eur|dollar|dollars|euro|euros|cent|cents|pound|pounds|degree|degrees")


# Number words.
NUMBERS = ("one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|"
           "twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion|dozen")

#: Places of a bit field that tells which two tokens some window begins with.
FIELD = 1 << 17


def canonical(text: Column) -> Column:
    """The text's canonical tokens, each followed by one space."""
    t = F.translate(F.coalesce(text, F.lit("")), "<> \n\r\t", "      ")
    t = F.replace(t, F.lit("%"), F.lit(" percent "))
    t = F.regexp_replace(t, r"(?<=[\p{Ll},;] )(\p{Lu}\p{L}*)(?![\p{L}\p{N}])", "<name:$1>")
    t = F.regexp_replace(t, rf"(?<![\p{{L}}\p{{N}}:.,])([0-9]+(?:[.,][0-9]+)*)(?:(?![\p{{L}}\p{{N}}])|(?=(?i:{UNITS})(?![\p{{L}}\p{{N}}])))", "<num:$1>")
    t = F.concat(F.lit(" "), F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}<>:.,]+|[.,:]+(?![^<> ]*>)", " "), F.lit(" "))
    t = F.regexp_replace(t, rf" (?=[bdefhmnost])({NUMBERS})(?= )", " <num:$1>")
    t = F.regexp_replace(t, rf"(<num:[^ >]*>) *({UNITS})(?= )", "$1 <unit:$2>")
    return F.concat(F.trim(F.regexp_replace(t, " +|(?<=>)(?=[^ ])|(?<=[^ ])(?=<)", " ")), F.lit(" "))


def _words(text: Column) -> Column:
    return F.filter(F.split(canonical(text), " "), lambda x: x != "")


def _plain(x: Column) -> Column:
    """The word with a mark behind it, whether a name or not; other slots as they are."""
    return F.when(x.startswith("<name:"), F.substring(x, 7, 1 << 30)).otherwise(F.concat(x, F.lit(">")))


def _templates(words: Column, named: bool) -> Column:
    """Hashes of the words, slots without their values; names are slots too if `named`."""
    if named:
        return F.transform(words, lambda x: F.xxhash64(F.when(x.startswith("<"), F.substring_index(x, ":", 1)).otherwise(x)))
    word = lambda x: F.when(x.startswith("<name:"), F.regexp_extract(x, ":(.*)>", 1)).when(x.startswith("<"), F.substring_index(x, ":", 1))
    return F.transform(words, lambda x: F.xxhash64(word(x).otherwise(x)))


def _key(hashes: Column, i: Column, n: int) -> Column:
    return F.xxhash64(*(F.get(hashes, i + j) for j in range(n)))


_KEYS = "array<struct<at:int,key:bigint>>"


def _keys(hashes: Column, n: int) -> Column:
    """(at, key) of each `n` successive words."""
    key = lambda i: F.struct(i.alias("at"), _key(hashes, i, n).alias("key"))
    return F.when(F.size(hashes) >= n, F.transform(F.sequence(F.lit(0), F.size(hashes) - n), key)).otherwise(F.array().cast(_KEYS))


def _beginning(hashes: Column, field: Column) -> Column:
    """The places whose two words some window may begin with, by the bit field."""
    marked = lambda i: F.substring(field, F.pmod(_key(hashes, i, 2), F.lit(FIELD)).cast("int") + 1, F.lit(1)) == F.lit(b"\x01")
    return F.when(F.size(hashes) >= 2, F.filter(F.sequence(F.lit(0), F.size(hashes) - 2), marked)).otherwise(F.array().cast("array<int>"))


def _keys_at(places: Column, hashes: Column, n: int, other: Column | None = None) -> Column:
    """(at, key) of the windows of `n` words at the places; no key where `other` has the same one."""
    key = lambda i: _key(hashes, i, n) if other is None else F.nullif(_key(hashes, i, n), _key(other, i, n))
    return F.transform(F.filter(places, lambda i: i + n <= F.size(hashes)), lambda i: F.struct(i.alias("at"), key(i).alias("key")))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """Items once each: item (names the row), item_id, words, tokens, plain (how many are no slots), hashes, named."""
    items = benchmark.where("item_id is not null").select("item_id", _words(F.col("text")).alias("words")).distinct().where("size(words) > 0")
    return items.select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words", F.size("words").alias("tokens"),
                        F.size(F.filter("words", lambda x: ~x.startswith("<"))).alias("plain"),
                        _templates(F.col("words"), False).alias("hashes"), _templates(F.col("words"), True).alias("named"))


def benchmark_windows(items: DataFrame, window: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """Windows (item, tokens, at, n, key, sure) by which items are looked for: all that have `literals`
    plain tokens; of an item that has none of these the first one with the most (not sure)."""
    n = F.least(F.col("tokens"), F.lit(window))

    def looked_for(hashes: str, slot: str) -> DataFrame:
        keys = F.lit(None)
        for k in range(1, window + 1):
            keys = F.when(n == k, _keys(F.col(hashes), k)).otherwise(keys)
        wins = items.select("item", "words", "tokens", n.alias("n"), F.col(hashes).alias("h"), F.inline(keys))
        wins = wins.withColumn("mark", F.when(F.col("n") >= 2, F.pmod(_key(F.col("h"), F.col("at"), 2), F.lit(FIELD))))
        wins = wins.withColumn("plain", F.size(F.filter(F.slice("words", F.col("at") + 1, F.col("n")), lambda x: ~x.rlike(slot))))
        best = (wins.groupBy("item").agg(F.max(F.struct("plain", -F.col("at"))).alias("b"))
                .select("item", (F.col("b.plain") >= literals).alias("rich"), (-F.col("b.col2")).alias("first")))
        return (wins.join(best, "item").where((F.col("plain") >= literals) | ~F.col("rich") & (F.col("at") == F.col("first")))
                .select("item", "tokens", "at", "n", "key", "mark", (F.col("rich") & (F.col("n") == window)).alias("sure")))

    return looked_for("hashes", "^<(num|unit):").unionByName(looked_for("named", "^<")).distinct()


def _same(a: Column, b: Column) -> Column:
    """Whether a document's word b may stand for an item's word a; for a name any word may."""
    slot = F.when(a.startswith("<name:"), ~b.startswith("<") | b.startswith("<name:")).otherwise(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1))
    return F.coalesce(F.when(a.startswith("<"), slot).otherwise(_plain(a) == _plain(b)), F.lit(False))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """Rows (doc_id, item_id, first_token, n_windows, n_slots, n_changed): each pair of a document
    (doc_id, text) and an item (item_id, text) that it holds, at its best alignment (most windows,
    then the first); slots with values and how many of them differ from the item's."""
    items = saved(benchmark_items(benchmark))
    wins = saved(benchmark_windows(items, window, literals))
    lengths = sorted(r["n"] for r in wins.select("n").distinct().collect())  # at most `window`
    docs = docs.where("doc_id is not null").select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    hashed = (docs.select("row", _words(F.col("text")).alias("words"))
              .select("row", _templates(F.col("words"), False).alias("hashes"), _templates(F.col("words"), True).alias("named")))
    # most places begin no window: one look at their first two words in a bit field of the windows saves their keys
    field = bytearray(FIELD)
    for r in wins.where("mark is not null").select("mark").distinct().collect():  # at most FIELD
        field[r["mark"]] = 1
    hashed = hashed.select("*", _beginning(F.col("hashes"), F.lit(field)).alias("places"), _beginning(F.col("named"), F.lit(field)).alias("named_places"))
    keys = [_keys(F.col(h), 1) for h in ("hashes", "named") if 1 in lengths]
    for n in (n for n in lengths if n > 1):
        keys += [_keys_at(F.col("places"), F.col("hashes"), n), _keys_at(F.col("named_places"), F.col("named"), n, F.col("hashes"))]
    tiles = hashed.select("row", F.inline(F.concat(*keys) if keys else F.array().cast(_KEYS))).where("key is not null").withColumnRenamed("at", "pos")
    hits = tiles.join(small(wins), "key").select("row", "item", "tokens", "sure", "at", (F.col("pos") - F.col("at")).alias("first_token"))
    aligned = saved(hits.groupBy("row", "item", "tokens", "sure", "first_token").agg(F.collect_set("at").alias("ats")))

    held = docs.join(small(aligned.select("row").distinct()), "row", "left_semi").dropDuplicates(["row"]).select("row", "doc_id", _words(F.col("text")).alias("doc_words"))
    both = aligned.join(held, "row").join(small(items.select("item", "item_id", "words", "plain")), "item")
    # the item's tokens that the document has in their places; and those in windows found, which may
    # be put together with the ones of near alignments, as words that came in or went shift the rest
    place = lambda i: F.struct(i.alias("i"), F.get("words", i).alias("item"), F.get("doc_words", F.col("first_token") + i).alias("doc"))
    found = both.select("row", "doc_id", "item", "item_id", "tokens", "plain", "sure", "first_token", "ats", F.size("doc_words").alias("doc_tokens"),
                        F.filter(F.transform(F.sequence(F.lit(0), F.col("tokens") - 1), place), lambda x: _same(x["item"], x["doc"])).alias("same"))
    reach = F.greatest(F.lit(window), F.floor(F.col("tokens") / 4))
    near = F.floor(F.col("first_token") / reach)
    inside = F.filter("same", lambda x: F.exists("ats", lambda a: (a <= x["i"]) & (x["i"] < a + window)))
    part = lambda joined, at, same: F.struct(F.lit(joined).alias("joined"), at.cast("long").alias("part"), same.alias("same"))
    every = F.array(part(False, F.col("first_token"), F.col("same")), part(True, near, inside), part(True, near - 1, inside))
    key = ["row", "doc_id", "item", "item_id", "tokens", "plain", "sure", "doc_tokens"]
    parts = (found.select(*key, "first_token", "ats", F.inline(every)).groupBy(*key, "joined", "part")
             .agg(F.min("first_token").alias("first_token"), F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("n_windows"),
                  F.flatten(F.collect_list("same")).alias("same")))
    slots = F.array_distinct(F.transform(F.filter("same", lambda x: x["item"].startswith("<")),
                                         lambda x: F.struct(x["item"].alias("item"), _plain(x["item"]).alias("was"), _plain(x["doc"]).alias("now"))))
    parts = parts.select("*", slots.alias("slots"), F.size(F.array_distinct(F.transform("same", lambda x: x["i"]))).alias("n_same"))
    parts = parts.select("*", F.size("slots").alias("n_slots"), F.size(F.filter("slots", lambda p: p["was"] != p["now"])).alias("n_changed"))
    # nearly all of a short item, little more than half of a long one
    need = F.when(F.col("sure"), F.ceil(F.least(F.col("tokens") * 0.85, F.col("tokens") * 0.5 + 6))).otherwise(F.col("tokens"))
    kept = (parts.where(F.col("n_same") >= need)
            .where(F.size(F.array_distinct(F.transform("slots", lambda p: p["item"]))) == F.col("n_slots"))
            .where((F.col("plain") >= literals) | (F.col("n_changed") == 0))
            .where((F.col("tokens") >= literals) | (F.col("doc_tokens") == F.col("tokens"))))
    best = F.max(F.struct("n_windows", -F.col("first_token"), "n_slots", "n_changed")).alias("b")
    return (kept.groupBy("doc_id", "item_id").agg(best)
            .select("doc_id", "item_id", (-F.col("b.col2")).cast("long").alias("first_token"), F.col("b.n_windows").cast("long").alias("n_windows"),
                    F.col("b.n_slots").cast("long").alias("n_slots"), F.col("b.n_changed").cast("long").alias("n_changed")))
