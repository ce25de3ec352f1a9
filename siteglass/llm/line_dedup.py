"""Line dedup across documents by a deletion-neighbourhood join, in DataFrame operations only.

A line (a piece of a text between line feeds) is removed when an earlier line of the corpus, by doc_id and line
number, has the same words or, from ``fuzzy_words`` words on, words within one edit: one word replaced, inserted or
deleted. What counts as earlier is judged on the input. Lines under ``min_words`` words stay, unless ``fold_short`` (as in
the query and the pipeline) lets them go too where they equal an earlier line and have a visible character.

Equal lines are folded first, by three 64-bit hashes. Variants within the bound leave out one word: replaced words meet
under equal variants of both lines, an inserted word under the longer line's variant and the shorter line as it is.
Emitting all of them would multiply the corpus by its line length, so lines first meet under variants that leave out
half of the words: one edit leaves the first or the last half of the shorter line intact. Only lines with company
there emit the single-word variants of the other half, as hashed keys. Each key keeps its earliest line of either
kind, pre-aggregated, so a hot key costs a row a task and no pair within a group is emitted; the edit distance of a
line to that earliest one is then verified on the words.

Null texts have no lines and stay null; rows with a null doc_id stay as they are. Rows that repeat a doc_id and text
are one document; lines of texts that differ under one doc_id count by their number, and a number removed in one goes
in all. Texts and lines of any length are taken whole; an empty table gives an empty one. Other columns pass through,
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, work_dir


@dataclass(frozen=True)
class Params:
    min_words: int = 5
    fuzzy_words: int = 10
    fold_short: bool = False


VISIBLE = r"[^\s\p{Z}\p{Cc}\p{Cf}]"


def words_of(line: Column) -> Column:
    """Words are what stands between single spaces, after spaces at either end are dropped."""
    return F.split(F.trim(line), " ")


def _half(words: Column, least: Column, last: bool) -> Column:
    """Hash of the first or last half of the words, as long as half of the shorter line of a pair."""
    m = F.greatest(F.floor((least - 1) / 2).cast("int"), F.lit(0))
    return F.xxhash64(F.slice(words, F.size(words) - m + 1, m) if last else F.slice(words, F.lit(1), m))


def lines_of(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, line_no, the number of words n and hashes of every line that can be removed.

    h is the hash of all words; p0 and s0 of the halves by the line's own length, which with h tell lines apart; p1
    and s1 of the halves if the line is the longer of a pair. A nested transform splits each line once.
    """

    def hashes(words: Column, i: Column) -> Column:
        n = F.size(words)
        parts = {"p0": (n, False), "s0": (n, True), "p1": (n - 1, False), "s1": (n - 1, True)}
        found = {"line_no": i, "n": n, "h": F.xxhash64(words)} | {c: _half(words, *x) for c, x in parts.items()}
        if p.fold_short:  # halves of so few words may be empty and tell nothing apart
            found |= {c: F.when(n < p.min_words, F.xxhash64(F.lit(c), words)).otherwise(found[c]) for c in SAME[1:]}
            found["shown"] = (n >= p.min_words) | F.exists(words, lambda w: w.rlike(VISIBLE))
        return F.struct(*(x.alias(c) for c, x in found.items()))

    rows = F.transform(F.transform(F.split("text", "\n"), words_of), hashes)
    lines = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.inline(rows))
    return lines.where("shown").drop("shown") if p.fold_short else lines.where(F.col("n") >= p.min_words)


SAME = ["h", "p0", "s0"]


def distinct_lines(lines: DataFrame) -> DataFrame:
    """Each distinct line at its earliest place, with the number of its copies."""
    return lines.groupBy(*SAME).agg(F.min(F.struct("doc_id", "line_no", "n", "p1", "s1")).alias("at"), F.count(F.lit(1)).alias("copies")).select(*SAME, "at.*", "copies")


def company(uniq: DataFrame, p: Params) -> DataFrame:
    """Lines that share a half with another, with the roles and halves in which they do.

    Roles: r (a word replaced), g (the shorter of two lines), d (the longer). Half p: the first half is shared. A line
    of n words meets others of n as they are (role b: r or g), and of n + 1 under their halves for one word less.
    """
    rows = uniq.where(F.col("n") >= max(p.min_words, p.fuzzy_words - 1)).select(
        "doc_id",
        "line_no",
        F.inline(F.array(*(F.struct(F.lit(role).alias("role"), F.lit(half).alias("half"), F.xxhash64(F.lit(half), F.col("n") - (1 if role == "d" else 0), F.col(src)).alias("key")) for role, half, src in (("b", "p", "p0"), ("b", "s", "s0"), ("d", "p", "p1"), ("d", "s", "s1"))))),
    )
    base = F.count_if(F.col("role") == "b")
    keys = rows.groupBy("key").agg(base.alias("nb"), F.count(F.lit(1)).alias("c")).where("c > 1 and nb > 0").select("key", "nb", (F.col("c") - F.col("nb")).alias("nd"))
    met = {"r": (F.col("role") == "b") & (F.col("nb") > 1), "g": (F.col("role") == "b") & (F.col("nd") > 0), "d": F.col("role") == "d"}
    flags = [F.max(met[r] & (F.col("half") == h)).alias(r + h) for r in "rdg" for h in "ps"]
    return rows.join(keys, "key").groupBy("doc_id", "line_no").agg(*flags).where("rp or rs or dp or ds or gp or gs")


def variants(live: DataFrame) -> DataFrame:
    """key, role, doc_id, line_no of the single-word variants of lines with company."""

    def m(least: Column) -> Column:
        return F.floor((least - 1) / 2)

    def xor(items: Column) -> Column:
        return F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))

    n, i = F.col("n"), F.col("i")
    told = live.withColumns({"n": F.size("words"), "all": xor(F.transform("words", lambda w, i: F.xxhash64(w, i)))})
    rep = told.where("rp or rs").select("doc_id", "line_no", "rp", "rs", "n", "all", F.posexplode(F.transform("words", lambda w, i: F.xxhash64(w, i))).alias("i", "x"))
    rep = rep.where((F.col("rp") & (i >= m(n))) | (F.col("rs") & (i <= n - 1 - m(n))))
    rep = rep.select(F.xxhash64(F.lit("r"), "n", "i", F.col("all").bitwiseXOR(F.col("x"))).alias("key"), F.lit("r").alias("role"), "doc_id", "line_no")
    short = told.where("gp or gs").select(F.xxhash64(F.lit("d"), "n", "all").alias("key"), F.lit("g").alias("role"), "doc_id", "line_no")
    # without word i: the words before it keep their place, those after it move up by one
    every = live.where("dp or ds").withColumns({"n": F.size("words"), "up": xor(F.transform("words", lambda w, i: F.xxhash64(w, i - 1)))})
    both = F.transform("words", lambda w, i: F.struct(F.xxhash64(w, i).alias("stay"), F.xxhash64(w, i - 1).alias("move")))
    every = every.select("doc_id", "line_no", "dp", "ds", "n", "up", F.posexplode(both).alias("i", "x")).select("doc_id", "line_no", "dp", "ds", "n", "up", "i", "x.move", F.col("x.stay").bitwiseXOR(F.col("x.move")).alias("turn"))
    before = Window.partitionBy("doc_id", "line_no").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("up").bitwiseXOR(F.col("move")).bitwiseXOR(F.coalesce(F.bit_xor("turn").over(before), F.lit(0).cast("long")))
    gone = every.select("doc_id", "line_no", "dp", "ds", "n", "i", rest.alias("rest"))
    gone = gone.where((F.col("dp") & (i >= m(n - 1))) | (F.col("ds") & (i <= n - 1 - m(n - 1))))
    gone = gone.select(F.xxhash64(F.lit("d"), n - 1, "rest").alias("key"), F.lit("d").alias("role"), "doc_id", "line_no")
    return rep.unionByName(short).unionByName(gone)


def candidates(rows: DataFrame) -> DataFrame:
    """Each line with the earliest line it meets under an equal variant: doc_id, line_no, e_doc, e_line."""
    at = F.struct("doc_id", "line_no")
    best = rows.groupBy("key").agg(*(F.min(F.when(F.col("role") == r, at)).alias(r) for r in "rdg"), F.count(F.lit(1)).alias("c")).where("c > 1 and (r is not null or (d is not null and g is not null))").select("key", "r", "d", "g")
    met = F.when(F.col("role") == "r", F.col("r")).when(F.col("role") == "d", F.col("g")).otherwise(F.col("d"))
    pairs = rows.join(best, "key").select("doc_id", "line_no", met.alias("e")).where(F.col("e") < F.struct("doc_id", "line_no"))
    return pairs.select("doc_id", "line_no", F.col("e.doc_id").alias("e_doc"), F.col("e.line_no").alias("e_line")).distinct()


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays differ by at most one replaced, inserted or deleted word."""
    na, nb = F.size(a), F.size(b)
    both = F.least(na, nb)
    first = F.array_position(F.zip_with(F.slice(a, F.lit(1), both), F.slice(b, F.lit(1), both), lambda x, y: x == y), False).cast("int")
    at = F.when(first == 0, both + 1).otherwise(first)
    big = F.lit(2**31 - 1)
    tail = F.slice(a, at + F.when(na >= nb, 1).otherwise(0), big) == F.slice(b, at + F.when(nb >= na, 1).otherwise(0), big)
    return (F.abs(na - nb) <= 1) & ((first == 0) | tail)


def removed_lines(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """doc_id and the numbers of the lines to remove."""
    p = p or Params()
    folder = work_dir(docs.sparkSession)
    lines = materialize(lines_of(docs, p), folder)
    uniq = materialize(distinct_lines(lines), folder)
    per_doc = company(uniq, p).groupBy("doc_id").agg(F.collect_list(F.struct("line_no", *(r + h for r in "rdg" for h in "ps"))).alias("lines"))
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.join(per_doc, "doc_id").withColumn("all", F.split("text", "\n")).select("doc_id", F.inline(F.transform("lines", lambda x: F.struct(*(x[c].alias(c) for c in ("line_no", *(r + h for r in "rdg" for h in "ps"))), words_of(F.element_at("all", x["line_no"] + 1)).alias("words")))))
    live = materialize(found.dropDuplicates(["doc_id", "line_no"]), folder)
    pairs = candidates(materialize(variants(live), folder))
    mine = live.select("doc_id", "line_no", F.col("words").alias("a"))
    theirs = live.select(F.col("doc_id").alias("e_doc"), F.col("line_no").alias("e_line"), F.col("words").alias("b"))
    long_enough = (F.size("a") >= p.fuzzy_words) & (F.size("b") >= p.fuzzy_words)
    near = pairs.join(theirs, ["e_doc", "e_line"]).join(mine, ["doc_id", "line_no"]).where(long_enough & within_one_edit(F.col("a"), F.col("b"))).select("doc_id", "line_no").distinct().withColumn("near", F.lit(True))
    verdict = uniq.select(*SAME, "doc_id", "line_no", "copies").join(near, ["doc_id", "line_no"], "left").where("near or copies > 1").select(*SAME, F.struct("doc_id", "line_no").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    hit = lines.select("doc_id", "line_no", *SAME).join(verdict, SAME).where(F.col("near") | (F.struct("doc_id", "line_no") != F.col("first")))
    return hit.groupBy("doc_id").agg(F.array_distinct(F.array_sort(F.collect_list("line_no"))).alias("removed"))


def _free(docs: DataFrame, name: str) -> str:
    """``name``, longer until no column of ``docs`` is called so."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _marked(docs: DataFrame, p: Params | None) -> tuple[DataFrame, str]:
    """``docs`` with a column of the numbers of the lines to remove, null where there are none, and its name."""
    key, mark = _free(docs, "gone_doc"), _free(docs, "gone_lines")
    gone = removed_lines(docs, p).select(F.col("doc_id").alias(key), F.col("removed").alias(mark))
    return docs.join(gone, F.col("doc_id") == F.col(key), "left").drop(key), mark


def _kept_text(mark: str) -> Column:
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(mark, i)), "\n")
    return F.when(F.col(mark).isNull(), F.col("text")).otherwise(kept)


def dedup_lines(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """``docs`` with the removed lines out of text, and n_lines and n_removed (in place of columns so named)."""
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    marked, mark = _marked(docs, p)
    counts = {"n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))), "n_removed": F.when(F.col(mark).isNull(), 0).otherwise(F.size(mark))}
    return marked.select(*(_kept_text(mark).alias(c) if c == "text" else F.col(f"`{c}`") for c in own), *(x.cast("long").alias(c) for c, x in counts.items()))


def clean(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """``docs`` with the removed lines out of text, without documents that lost their last word; same columns.

    A column n_chars, if there is one, counts the code points of the new text.
    """
    marked, mark = _marked(docs, p)
    text = _kept_text(mark)
    left = marked.where(F.col(mark).isNull() | text.rlike("[^ \\t-\\r]"))

    def one(c: str) -> Column:
        if c == "text":
            return text.alias(c)
        if c == "n_chars":
            return F.when(F.col(mark).isNull(), F.col(c)).otherwise(F.char_length(text)).cast(docs.schema[c].dataType).alias(c)
        return F.col(f"`{c}`")

    return left.select(*(one(c) for c in docs.columns))


def digest(out: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256 (of the remaining text; empty for null)."""
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
