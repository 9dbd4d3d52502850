"""Line deduplication by a log-template tree, in DataFrame operations only.

Texts are cut into units: lines, and in lines the sentences. Tokens with a digit are masked. The tree has a fixed depth: a
unit's leaf is its count of tokens and its first tokens. Within a leaf, a token that enough of the leaf's texts have at a
position is a constant there and any other one is a variable field. The constants and fields of a unit are its template; a
unit with too few constants is a template by itself. Templates that recur across documents are dropped from all of them
but the one with the smallest doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.common import SPACE_CLASS, cut, fresh, words

FIELD = "<*>"
TOKEN = f"[^{SPACE_CLASS[1:-1]}]+"
#: Leading tokens of a leaf, tokens of a whole line from which on it has fields, tokens that a sentence inside a line needs.
DEPTH, MIN_TOKENS, MIN_SENTENCE = 3, 5, 8
#: Distinct texts in which a template recurs, and share of the leaf's texts (MIN_DOCS at least) that make a token constant.
MIN_DOCS, MIN_SHARE = 3, 0.1
#: Share of constants among all tokens, and among the unmasked ones after the leading tokens.
MIN_CONSTANT = 0.6
#: Buckets of the filter that says which documents are read again.
FILTER = 1 << 20
#: The place of a missing doc_id in the order of documents: last.
NO_ID = (1 << 63) - 1


def masked(line: Column) -> Column:
    """The line with FIELD for each token with a digit. The pattern only starts at tokens and never steps back."""
    inner = SPACE_CLASS[1:-1]
    replaced = F.regexp_replace(line, f"(?<![^{inner}])[^{inner}0-9]*+[0-9][^{inner}]*+", FIELD)
    return F.when(line.rlike("[0-9]"), replaced).otherwise(line)


def units(text: Column) -> Column:
    """The text in pieces that end after a newline, or after a full stop, ! or ? with a blank or tab; the last may be ''."""
    # The first group only says quickly where no unit can end.
    return F.split(F.coalesce(text, F.lit("")), "(?<=[\n \t])(?:(?<=\n)|(?<=[.!?][ \t]))")


def _line(unit: Column) -> Column:
    """A unit without white space at its ends, masked."""
    return masked(F.trim(unit, F.lit(" \t\r\n")))


def _id() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(NO_ID))


def unit_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, pos, line_key, leaf and n_tokens of every unit that has a template."""
    cutting = docs.select(_id().alias("doc_id"), F.xxhash64("text").alias("text_key"), units(F.col("text")).alias("units"))
    starts = lambda i: (i == 0) | F.endswith(F.get("units", i - 1), F.lit("\n"))
    ends = lambda u, i: F.endswith(u, F.lit("\n")) | (F.coalesce(F.get("units", i + 1), F.lit("")) == "")
    lines = F.transform("units", lambda u, i: F.struct(_line(u).alias("line"), (starts(i) & ends(u, i)).alias("whole")))
    # Counted before the rows are spread: a filter on columns would be evaluated with all that they are made from.
    counted = F.transform(lines, lambda x: F.struct(x["line"].alias("line"), x["whole"].alias("whole"), F.regexp_count(x["line"], F.lit(TOKEN)).alias("n_tokens")))
    rows = cutting.select("doc_id", "text_key", F.posexplode(counted).alias("pos", "u")).select("doc_id", "text_key", "pos", "u.*")
    worded = F.replace("line", F.lit(FIELD), F.lit("")).rlike(TOKEN)
    rows = rows.where((F.col("n_tokens") >= MIN_SENTENCE) | (F.col("whole") & ((F.col("n_tokens") >= MIN_TOKENS) | worded)))
    # Only the leading tokens are cut off; the last piece holds the rest of the line.
    leading = F.split("line", f"{SPACE_CLASS}+", DEPTH + 1)
    rows = rows.withColumn("t", F.when(F.col("n_tokens") >= MIN_TOKENS, leading))
    deep = F.xxhash64("n_tokens", *[F.get("t", F.lit(i)) for i in range(DEPTH)])
    leaf = F.when(F.col("n_tokens") >= MIN_TOKENS, deep).otherwise(F.xxhash64("n_tokens", "line"))
    return rows.select("doc_id", "text_key", "pos", F.xxhash64("line").alias("line_key"), leaf.alias("leaf"), "n_tokens")


def _tokens(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """lines (with place: doc_id, text_key and pos of one of its units) and t, the line's tokens."""
    sought = lines.groupBy("place.doc_id", "place.text_key").agg(F.collect_list(F.struct("place.pos", *lines.columns)).alias("sought"))
    # A filter of at most FILTER rows keeps most of the other documents from the shuffle.
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER))
    buckets = lines.select(F.pmod(F.xxhash64("place.doc_id"), F.lit(FILTER)).alias("bucket")).distinct()
    texts = docs.select(_id().alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    texts = texts.join(F.broadcast(buckets), bucket == F.col("bucket"), "left_semi").join(sought, ["doc_id", "text_key"])
    found = texts.select("sought", units(F.col("text")).alias("units"))
    found = found.select(F.explode(F.transform("sought", lambda s: F.struct(s.alias("s"), _line(F.get("units", s["pos"])).alias("line")))).alias("f"))
    found = found.select(*[F.col(f"f.s.{c}").alias(c) for c in lines.columns if c != "place"], words(F.col("f.line")).alias("t"))
    return found.dropDuplicates(["line_key"])


def templates(docs: DataFrame, pairs: DataFrame, min_docs: int, min_share: float, min_constant: float) -> DataFrame:
    """line_key and template (a hash) of every line of pairs."""
    long = F.col("n_tokens") >= MIN_TOKENS
    line = ["line_key", "leaf", "n_tokens"]
    counted = pairs.where(long).groupBy(*line).agg(F.sum(F.when(F.col("lines") == 1, 1).otherwise(0)).alias("single"), F.min("place").alias("place"))
    lines = cut(_tokens(docs, cut(counted)))
    tokens = lines.select(*line, "single", F.posexplode("t").alias("at", "token"))
    # Texts that have a token there: those with one line in the leaf are added up by lines, the others are told apart.
    slot = ["leaf", "at", "token"]
    alone = tokens.where((F.col("token") != FIELD) & (F.col("single") > 0)).groupBy(*slot).agg(F.sum("single").alias("texts"))
    several = pairs.where(long & (F.col("lines") > 1)).select("line_key", "text_key").join(lines.select("line_key", "leaf", "t"), "line_key")
    several = several.select("leaf", "text_key", F.posexplode("t").alias("at", "token")).where(F.col("token") != FIELD)
    several = several.distinct().groupBy(*slot).agg(F.count("*").alias("texts"))
    support = alone.unionByName(several).groupBy(*slot).agg(F.sum("texts").alias("texts")).where(F.col("texts") >= min_docs)
    in_leaf = cut(pairs.where(long & F.col("of_text")).groupBy("leaf").agg(F.count("*").alias("all_texts")))
    constant = support.join(in_leaf, "leaf").where(F.col("texts") >= min_share * F.col("all_texts")).select(*slot, F.lit(1).alias("constant"))
    hit = F.coalesce("constant", F.lit(0))
    later = F.col("at") >= DEPTH
    parsed = tokens.join(constant, slot, "left").groupBy(*line).agg(
        F.sort_array(F.collect_list(F.struct("at", "token", hit.alias("constant")))).alias("parts"),
        F.sum(hit).alias("n_constant"),
        F.sum(F.when(later, hit).otherwise(0)).alias("later_constant"),
        F.sum(F.when(later & (F.col("token") != FIELD), 1).otherwise(0)).alias("later"),
    )
    enough = (F.col("n_constant") >= min_constant * F.col("n_tokens")) & (F.col("later_constant") >= min_constant * F.col("later"))
    general = F.transform("parts", lambda p: F.when(p["constant"] == 1, p["token"]).otherwise(FIELD))
    itself = F.transform("parts", lambda p: p["token"])
    shown = F.array_join(F.when(enough, general).otherwise(itself), " ")
    # A line too short for fields is its own template and alone in its leaf.
    short = pairs.where(~long).select("line_key", F.col("leaf").alias("template")).distinct()
    return parsed.select("line_key", F.xxhash64("leaf", shown).alias("template")).unionByName(short)


def recurring(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, min_constant: float = MIN_CONSTANT
) -> DataFrame:
    """doc_id, text_key and pos of the units to drop.

    Documents are counted by distinct texts, so exact copies alone don't make their lines recur, nor do repeats in one
    text. Leaves with fewer units than a template needs, or of a single text, are left out first.
    """
    keys = cut(unit_keys(docs))
    busy = keys.groupBy("leaf").agg(F.count("*").alias("n"), F.min("text_key").alias("a"), F.max("text_key").alias("b"))
    # Written, so that both sides of the join come straight from a shuffle and Spark can split a leaf's units.
    busy = cut(busy.where((F.col("n") >= min_docs) & (F.col("a") != F.col("b"))).select("leaf"))
    keys = cut(keys.join(busy, "leaf"))
    pairs = keys.groupBy("line_key", "leaf", "n_tokens", "text_key").agg(F.min(F.struct("doc_id", "text_key", "pos")).alias("place"))
    of_text = Window.partitionBy("leaf", "text_key")
    pairs = cut(
        pairs.withColumn("lines", F.count("*").over(of_text))
        .withColumn("of_text", F.row_number().over(of_text.orderBy("line_key")) == 1)
    )
    of_line = cut(templates(docs, pairs, min_docs, min_share, min_constant))
    used = pairs.select("line_key", "text_key", F.col("place.doc_id").alias("first")).join(of_line, "line_key")
    texts = used.groupBy("template", "text_key").agg(F.min("first").alias("first"))
    chosen = texts.groupBy("template").agg(F.count("*").alias("texts"), F.min("first").alias("first"))
    chosen = cut(of_line.join(cut(chosen.where(F.col("texts") >= min_docs)), "template").select("line_key", "first"))
    return keys.join(chosen, "line_key").where(F.col("doc_id") != F.col("first")).select("doc_id", "text_key", "pos")


def drop_recurring(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, min_constant: float = MIN_CONSTANT
) -> DataFrame:
    """docs with recurring units taken out of the text, n_lines (lines of the text before) and n_dropped (units).

    A unit is a line or, in a line of several sentences, a sentence with the white space after it; a line keeps its newline
    unless all of it goes. Whole lines need a token without a digit, or MIN_TOKENS tokens; sentences inside lines need
    MIN_SENTENCE, so common short sentences of prose stay. A null text stays null with no lines; a text that loses all its
    units is empty. Rows that share a doc_id count as one document, as do those without doc_id, which come last. Repeated
    rows lose the same units. Other columns pass through (earlier n_lines and n_dropped are replaced). All documents are
    counted. An empty table gives none. Time grows in proportion to a text's units, however many of them recur.
    """
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    gone = recurring(docs.select("doc_id", "text"), min_docs, min_share, min_constant)
    gone = gone.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    # One character for each unit up to the last one that goes: 1 if it goes.
    before = lambda i: F.coalesce(F.get("gone", i - 1), F.lit(-1))
    flags = F.array_join(F.transform("gone", lambda p, i: F.concat(F.repeat(F.lit("0"), p - before(i) - 1), F.lit("1"))), "")
    doc_id, text_key, mark, cuts = fresh(docs, "doc_id_", "text_key_", "flags_", "units_")
    gone = gone.select(
        F.col("doc_id").alias(doc_id), F.col("text_key").alias(text_key), flags.cast("binary").alias(mark), F.size("gone").cast("long").alias("n_dropped")
    )
    rows = docs.select(*[F.col(f"`{c}`") for c in names], _id().alias(doc_id), F.xxhash64("text").alias(text_key))
    joined = rows.join(gone, [doc_id, text_key], "left").withColumn(cuts, F.when(F.col(mark).isNotNull(), units(F.col("text"))))
    newline = F.lit("\n")
    rest = lambda u, i: F.when((i > 0) & F.endswith(u, newline) & ~F.endswith(F.get(cuts, i - 1), newline), newline).otherwise("")
    kept = F.transform(cuts, lambda u, i: F.when(F.substring(mark, i + 1, F.lit(1)) == F.lit(b"1"), rest(u, i)).otherwise(u))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    text = F.when(F.col(cuts).isNotNull(), F.array_join(kept, "")).otherwise(F.col("text"))
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in names], n_lines.alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).alias("n_dropped")
    )


# The same for DuckDB, with strings in place of hashes.
SQL = r"""
WITH docs AS (SELECT doc_id, text, coalesce(doc_id, 9223372036854775807) AS id FROM documents),
cuts AS (SELECT DISTINCT id, text, list_filter(regexp_extract_all(coalesce(text, ''), '(?s).*?(?:\n|[.!?][ \t]|\z)'), lambda u: u <> '') AS units FROM docs),
flat AS (SELECT id, text, unnest(units) AS unit, unnest(range(len(units))) AS pos, len(units) AS n_units FROM cuts),
raw AS (SELECT *, pos = 0 OR ends_with(lag(unit) OVER (PARTITION BY id, text ORDER BY pos), chr(10)) AS starts FROM flat),
marked AS (SELECT id, text, unit, pos, starts, starts AND (ends_with(unit, chr(10)) OR pos = n_units - 1) AS whole,
  regexp_replace(trim(unit, concat(' ', chr(9), chr(10), chr(13))), '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g') AS line FROM raw),
split AS (SELECT *, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS t FROM marked),
keys AS (SELECT id, text, pos, t, len(t) AS n, array_to_string(t, ' ') AS line,
  len(t)::varchar || ' ' || CASE WHEN len(t) >= 5 THEN array_to_string(t[1:3], ' ') ELSE array_to_string(t, ' ') END AS leaf
  FROM split WHERE len(t) >= 8 OR whole AND (len(t) >= 5 OR len(list_filter(t, lambda w: replace(w, '<*>', '') <> '')) > 0)),
lines AS (SELECT leaf, line, any_value(t) AS t, any_value(n) AS n FROM keys GROUP BY leaf, line),
tokens AS (SELECT leaf, line, n, unnest(t) AS token, unnest(range(n)) AS place FROM lines),
leaves AS (SELECT leaf, count(DISTINCT text) AS all_texts FROM keys GROUP BY leaf),
seen AS (SELECT k.leaf, k.text, unnest(k.t) AS token, unnest(range(k.n)) AS place FROM keys k),
support AS (SELECT s.leaf, place, token, token <> '<*>' AND count(DISTINCT text) >= 3 AND count(DISTINCT text) >= 0.1 * any_value(all_texts) AS constant
  FROM seen s JOIN leaves USING (leaf) GROUP BY s.leaf, place, token),
parsed AS (SELECT leaf, line, any_value(n) AS n, sum(constant::int) AS n_constant, coalesce(sum(constant::int) FILTER (place >= 3), 0) AS later_constant,
  count(*) FILTER (place >= 3 AND token <> '<*>') AS later, string_agg(CASE WHEN constant THEN token ELSE '<*>' END, ' ' ORDER BY place) AS general
  FROM tokens JOIN support USING (leaf, place, token) GROUP BY leaf, line),
used AS (SELECT k.id, k.text, k.pos, k.leaf, CASE WHEN p.n >= 5 AND n_constant >= 0.6 * p.n AND later_constant >= 0.6 * later THEN general ELSE p.line END AS template
  FROM keys k JOIN parsed p USING (leaf, line)),
chosen AS (SELECT leaf, template, min(id) AS first FROM used GROUP BY leaf, template HAVING count(DISTINCT text) >= 3),
gone AS (SELECT DISTINCT id, text, pos FROM used JOIN chosen USING (leaf, template) WHERE id <> first),
kept AS (SELECT raw.id, raw.text, count(gone.pos) AS n_dropped, string_agg(CASE WHEN gone.pos IS NULL THEN unit WHEN NOT starts AND ends_with(unit, chr(10)) THEN chr(10) ELSE '' END, ''
  ORDER BY raw.pos) AS body FROM raw LEFT JOIN gone USING (id, text, pos) GROUP BY raw.id, raw.text)
SELECT doc_id, CASE WHEN docs.text IS NULL THEN 0 ELSE len(string_split(docs.text, chr(10))) END AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
  coalesce(body, docs.text) AS text FROM docs LEFT JOIN kept ON docs.id = kept.id AND docs.text IS NOT DISTINCT FROM kept.text
"""
