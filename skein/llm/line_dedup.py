"""Near-duplicate lines across all documents, found by a deletion-neighbourhood join; the earliest stays.

A line is the text between line feeds, and its words are what stands between its
blanks. With `fold`, as the queries use it, lines are compared by their words in lower
case, parted by runs of white space; a letter of a script written without blanks then
counts as a word towards `least_words`, so that repeats of such lines go as well.
Lines with fewer than `least_words` words are never removed. Equal lines are
one class; lines with `fuzzy_words` words or more also match when one word is
inserted, deleted or replaced. A line goes if an equal or near line stands earlier,
that is in a smaller doc_id or further up in the same document; lines are judged on
the input.

Two lines one word apart agree in the first or in the last half of their words, so
only lines that share a half with a different line (counted by groupBy) have their
deletion neighbourhood written out. A variant's key is made of sums of hashes of its
words, each bound to its place: the whole line, the line without word i (the rest
moved up: a deletion), the line with a gap at word i (a replacement). Sums over
windows give all variants in time linear in the line. Equal keys are joined through an
aggregate of the earliest line for each key, never pair by pair, and the edit distance
of what is found is verified on the words.

Edge cases: null and empty texts have no lines to remove and are kept; documents
without an id count as earliest; rows are told apart by id and a 64-bit hash of their
text, which also orders rows of one id, so that each loses its own lines only; of rows
with the same id and text one counts and the others lose every line with enough words;
blank lines stay; extra columns are kept, whatever their names. Lines are told apart by
a 64-bit hash and their number of words; among a billion different lines the chance that
any two of one length share it is about one in forty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import aside, materialize, stored

#: Half keys that so few lines share may be broadcast; more are joined by a shuffle.
_SMALL = 1_000_000
#: Letters of scripts written without blanks.
_UNSPACED = "[" + "".join(rf"\p{{Is{script}}}" for script in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan")) + "]"


def folded(text: Column) -> Column:
    """text in lower case with each run of white space but line feeds as one blank.

    For speed white space is replaced only where there is other than blanks, which is
    found much faster than replaced, and the regex runs only where two blanks meet.
    """
    low = blanks = F.lower(text)
    other = F.lit(False)
    for c in "\t\x0b\f\r":
        blanks, other = F.replace(blanks, F.lit(c), F.lit(" ")), other | F.contains(text, F.lit(c))
    blanks = F.when(other, blanks).otherwise(low)
    return F.when(F.contains(blanks, F.lit("  ")), F.regexp_replace(blanks, " {2,}", " ")).otherwise(blanks)


def _n_words(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _has_words(line: Column, least: int) -> Column:
    """Whether a line has so many words; read no further than needed, for filters are worked out before the columns."""
    return F.octet_length(F.substring_index(line, " ", least - 1)) < F.octet_length(line) if least > 1 else line.isNotNull()


def _enough(line: Column, least_words: int, fold: bool) -> Column:
    """Whether a line, with fold a folded and trimmed one, has the words to be removed."""
    enough = _has_words(line, least_words)
    if fold:
        enough = enough | ((F.octet_length(line) > F.length(line)) & (F.regexp_count(line, F.lit(_UNSPACED)) >= least_words))
    return enough & (line != "")


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(0))


def _row() -> Column:
    """With the id, what names a row: a hash of its text and of whether it has an id."""
    return F.xxhash64(F.col("doc_id").isNull(), "text")


def lines(docs: DataFrame, least_words: int, fold: bool = False, short: bool = False) -> DataFrame:
    """doc_id, row, line_no, line, its hash, its number of words and whether they are enough; with short also those with too few but some."""
    text = folded(F.col("text")) if fold else F.col("text")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row().alias("row"), text.alias("text"))
    # folded in a column of its own, and the outer form: else Spark folds each text again to tell whether it has lines
    apart = own.select("doc_id", "row", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
    if fold:
        apart = apart.withColumn("line", F.trim("line"))
    enough = _enough(F.col("line"), least_words, fold)
    apart = apart.where(F.col("line").rlike(r"[^ \t\x0B\f\r]") if short else enough)
    return apart.withColumns({"n": _n_words(F.col("line")), "line_key": F.xxhash64("line"), "enough": enough if short else F.lit(True)})


def keyed_lines(docs: DataFrame, least_words: int, fold: bool, short: bool) -> DataFrame:
    """lines() without the lines themselves, written once as a table, so that texts are split once for all that needs only their keys."""
    return stored(lines(docs, least_words, fold, short).drop("line"), "line-keys")


def _halves(n: Column) -> Column:
    """Keys of h(n) and h(n - 1) words from either end: what a line shares with one of as many words or one more or less.

    Both numbers are the same for an odd n.
    """
    key = lambda h, side: F.xxhash64(F.call_function("substring_index", F.col("line"), F.lit(" "), h * side), h * side)
    h, low = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    both = F.array(key(h, 1), key(h, -1))
    return F.when(h == low, both).otherwise(F.concat(both, F.array(key(low, 1), key(low, -1))))


def _candidates(docs: DataFrame, least_words: int, fuzzy_words: int, fold: bool) -> DataFrame:
    """line_key, n, line, first and the shared sides of the distinct lines that have a half in common with a different line."""
    own = lines(docs, max(least_words, fuzzy_words), fold).where(_has_words(F.col("line"), fuzzy_words))
    apart = own.select("line_key", F.explode(_halves(F.col("n"))).alias("half"))
    shared = materialize(apart.groupBy("half").agg(F.min("line_key").alias("a"), F.max("line_key").alias("b")).where("a <> b").select("half"))
    if shared.count() <= _SMALL:
        shared = F.broadcast(shared)
    sides = own.select("doc_id", "row", "line_no", "line_key", "n", "line", F.posexplode(_halves(F.col("n"))).alias("side", "half"))
    hit = sides.join(shared, "half").select("line_key", "n", "line", F.struct("doc_id", "row", "line_no").alias("first"), (F.col("side") % 2 == 0).alias("head"))
    return hit.groupBy("line_key", "n").agg(F.any_value("line").alias("line"), F.min("first").alias("first"), F.max("head").alias("head"), F.min("head").alias("only_head"))


def _variants(texts: DataFrame) -> DataFrame:
    """line_key, n, first, whole and the key of every variant: the deletion neighbourhood."""
    apart = texts.select("line_key", "n", "first", "head", "only_head", F.posexplode(F.split("line", " ")).alias("i", "word"))
    for k in (1, 2):
        # 40-bit values: sums of millions of them fit in a long
        apart = apart.withColumn(f"g{k}", F.shiftright(F.xxhash64(F.lit(k), "word", "i"), 24)).withColumn(f"up{k}", F.shiftright(F.xxhash64(F.lit(k), "word", F.col("i") - 1), 24))
    line = Window.partitionBy("line_key", "n")
    upto = line.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = line.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for k in (1, 2):
        apart = apart.withColumn(f"t{k}", F.sum(f"g{k}").over(whole)).withColumn(f"d{k}", F.sum(f"g{k}").over(upto) - F.col(f"g{k}") + F.sum(f"up{k}").over(whole) - F.sum(f"up{k}").over(upto))
    n, i = F.col("n"), F.col("i")
    low = F.floor((n - 1) / 2)
    # with the head shared, the words that differ lie behind it, and the other way round
    apart = apart.where((F.col("head") & (i >= low)) | (~F.col("only_head") & (i < n - low)) | (i == 0))
    gap = F.xxhash64(F.lit("gap"), n, i, F.col("t1") - F.col("g1"), F.col("t2") - F.col("g2"))
    cut = F.xxhash64(F.lit("cut"), n - 1, "d1", "d2")
    own = F.xxhash64(F.lit("cut"), n, "t1", "t2")
    entry = lambda key, is_whole: F.struct(key.alias("key"), F.lit(is_whole).alias("whole"))
    each = F.array_compact(F.array(entry(gap, False), entry(cut, False), F.when(i == 0, entry(own, True))))
    return apart.select("line_key", "n", "first", F.explode(each).alias("v")).select("line_key", "n", "first", F.col("v.key").alias("key"), F.col("v.whole").alias("whole"))


def near_lines(texts: DataFrame) -> DataFrame:
    """line_key, n and the earliest line one word apart, for lines that have one, be it earlier or not."""
    each = _variants(texts)
    # the earliest for each key, of whole lines and of lines cut short apart: two lines cut to the same may not be near, and must not hide one that is
    entry = F.struct("first", "line_key", "n")
    met = each.groupBy("key").agg(F.min(F.when(~F.col("whole"), entry)).alias("cut_first"), F.min(F.when(F.col("whole"), entry)).alias("all_first"), F.min("line_key").alias("a"), F.max("line_key").alias("b")).where("a <> b").drop("a", "b")
    # a line's own place does not move with its variants; that it is asked for here keeps the windows' shuffle the one of `met`
    own = each.where("first is not null").select("key", "line_key", "n")
    found = own.join(met, "key").select("line_key", "n", F.explode(F.array_compact(F.array("cut_first", "all_first"))).alias("o")).where("o.line_key <> line_key or o.n <> n")
    pairs = found.select("line_key", "n", F.col("o.line_key").alias("o_key"), F.col("o.n").alias("o_n"), F.col("o.first").alias("near_first")).distinct()
    a = texts.select("line_key", "n", F.col("line").alias("a"))
    b = texts.select(F.col("line_key").alias("o_key"), F.col("n").alias("o_n"), F.col("line").alias("b"))
    checked = pairs.join(a, ["line_key", "n"]).join(b, ["o_key", "o_n"]).where(one_word_apart(F.split("a", " "), F.split("b", " ")))
    return checked.groupBy("line_key", "n").agg(F.min("near_first").alias("near_first"))


def one_word_apart(a: Column, b: Column) -> Column:
    """Whether one insertion, deletion or replacement of a word at most leads from a to b."""
    def common(x: Column, y: Column) -> Column:
        least = F.least(F.size(x), F.size(y))
        same = F.zip_with(F.slice(x, 1, least), F.slice(y, 1, least), lambda p, q: p == q)
        return F.when(F.array_contains(same, False), F.array_position(same, False) - 1).otherwise(least)

    return (F.abs(F.size(a) - F.size(b)) <= 1) & (common(a, b) + common(F.reverse(a), F.reverse(b)) >= F.greatest(F.size(a), F.size(b)) - 1)


def removed_lines(docs: DataFrame, least_words: int = 3, fuzzy_words: int = 8, fold: bool = False, seen: DataFrame | None = None) -> DataFrame:
    """doc_id, row and line_no of every line that an equal or near earlier line makes superfluous; rows of the same id and text are one.

    seen: the keyed lines of docs, where they are there already.
    """
    seen = (keyed_lines(docs, least_words, fold, False) if seen is None else seen).where("enough").drop("enough")
    spot = F.struct("doc_id", "row", "line_no")
    twice = seen.groupBy("line_key", "n").agg(F.min(spot).alias("first"), F.count("*").alias("times")).where("times > 1").select("line_key", "n", "first")
    near = near_lines(materialize(_candidates(docs, least_words, fuzzy_words, fold)))
    # only lines that stand more than once or have an earlier near line concern any occurrence
    kept = twice.join(near, ["line_key", "n"], "full").select("line_key", "n", F.least("first", "near_first").alias("keep"))
    # a near line that stands later than the line itself changes nothing
    return seen.join(materialize(kept), ["line_key", "n"]).where("keep < struct(doc_id, row, line_no)").select("doc_id", "row", "line_no")


def emptied(seen: DataFrame, gone: DataFrame) -> DataFrame:
    """_id and _row of the rows of `gone` that lose every line with enough words, and whose shorter lines all stand earlier too; seen has all lines that are not blank."""
    own = seen.withColumns({"_id": _id(), "_row": F.col("row")})
    # rows of the same id and text count once
    held = own.where("enough").groupBy("_id", "_row").agg(F.countDistinct("line_no").alias("_n"))
    stripped = materialize(held.join(gone.select("_id", "_row", F.size("_gone").alias("_lost")), ["_id", "_row"]).where("_n = _lost").select("_id", "_row"))
    spot = F.struct("doc_id", "row", "line_no")
    firsts = seen.where("not enough").groupBy("line_key").agg(F.min(spot).alias("first"))
    # a short line that stands nowhere earlier keeps its row
    rest = own.where("not enough").join(stripped, ["_id", "_row"], "left_semi")
    held_up = rest.join(firsts, "line_key").where(F.col("first").eqNullSafe(spot)).select("_id", "_row").distinct()
    return stripped.join(held_up, ["_id", "_row"], "left_anti")


def dedup(docs: DataFrame, least_words: int = 3, fuzzy_words: int = 8, fold: bool = False, drop_copies: bool = False) -> DataFrame:
    """docs with superfluous lines taken out of text, and n_lines and n_lines_removed.

    With drop_copies, a row goes that loses lines and of which no line is left but blank
    ones and lines too short to be removed that stand earlier as well.
    """
    seen = keyed_lines(docs, least_words, fold, drop_copies)
    gone = removed_lines(docs, least_words, fuzzy_words, fold, seen).groupBy(_id().alias("_id"), F.col("row").alias("_row")).agg(F.collect_set("line_no").alias("_gone"))
    if drop_copies:
        gone = materialize(gone)
        gone = gone.join(emptied(seen, gone).withColumn("_empty", F.lit(True)), ["_id", "_row"], "left")
    own, names = aside(docs.drop("n_lines", "n_lines_removed"), "doc_id", "text")
    # of rows with the same id and text the first counts; the window is dealt out and sorted as the join is
    ordered = [f"`{c}`" for c, kind in own.dtypes if c not in ("doc_id", "text") and not kind.startswith(("map", "array", "struct", "variant"))]
    copies = Window.partitionBy("_id", "_row").orderBy(*(ordered or ["_row"]))
    keyed = own.withColumn("_id", _id()).withColumn("_row", _row()).withColumn("_copy", F.row_number().over(copies) > 1)
    # the lines are a column, so that they are split once and not anew for each line that stays
    joined = keyed.join(gone, ["_id", "_row"], "left").withColumn("_parts", F.split("text", "\n"))
    parts = F.col("_parts")
    places = F.sequence(F.lit(0), F.size(parts) - 1)
    line = lambda i: F.trim(folded(F.get(parts, i))) if fold else F.get(parts, i)
    joined = joined.withColumn("_gone", F.when(F.col("_copy") & F.col("text").isNotNull(), F.filter(places, lambda i: _enough(line(i), least_words, fold))).otherwise(F.col("_gone")))
    if drop_copies:
        joined = joined.where(F.col("_empty").isNull() & ~(F.col("_copy") & F.coalesce(F.size("_gone") > 0, F.lit(False))))
    left = F.array_except(places, F.col("_gone"))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n"))
    n = F.coalesce(F.when(F.col("text").isNotNull(), F.size(parts)), F.lit(0)).cast("long")
    return joined.select(*((text if c == "text" else F.col(name)).alias(c) for c, name in names.items()), n.alias("n_lines"), F.when(F.col("_gone").isNull() | F.col("text").isNull(), F.lit(0)).otherwise(F.size(parts) - F.size(left)).cast("long").alias("n_lines_removed"))
