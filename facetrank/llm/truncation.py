"""Texts that were cut off before their end, and how often each source cuts. Pure SQL over the whole texts.

Trigrams of tokens are counted inside the texts, with how often a line ends after each, and as the last of a text; where
one is rare, its last pair stands for it. Each text's final trigram is joined to these counts. They say:

* phrase: it is frequent inside texts but almost never stands at the end of a text or line.
* word: after the same two tokens (or one), the last word is far more often the beginning of a longer one.
* open: the text has a length at which its source cuts, and its final trigram isn't one that usually ends a text or line.
  That a length is such a limit makes a cut likely, so that less is asked of the trigram than elsewhere.
* closing: nearly all texts of the source end with the same two tokens, and this one doesn't.

Two things show a cut that no trigram can contradict:

* mark: a mark of omission stands at the very end, and the text before it has the length of a limit.
* hunk: the last hunk of a diff has fewer lines than its header announces.

A length alone (`limit`) is reported but finds nothing: complete texts have such lengths too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetrank.functions.runtime import cut, spread, width
from facetrank.functions.skew import lookup

#: Characters of base85, base64 and hex. A run of them with small and capital letters and digits is data, not words.
DATA = r"[0-9A-Za-z!#$%&()*+\-/;<=>?@^_`{|}~]"
DATA_RUN = rf"(?<!\S)(?={DATA}*[0-9])(?={DATA}*[a-z])(?={DATA}*[A-Z]){DATA}{{40,}}"
HASH = r"\b(?=[a-f]*[0-9])[0-9a-f]{7,}\b"
#: Words of Latin letters, words of other letters, numbers, line ends, runs of blanks, single marks.
TOKEN = r"\p{IsLatin}+|[\p{L}&&[^\p{IsLatin}]]+|0|\n|  |[^\s\p{L}\p{N}]"
#: What stands for a mark that ends a sentence: one with a blank, a line end or nothing after it.
STOP = "\u241e"
#: What stands for a run of data.
RUN = "\u2422"
#: The last three tokens are first looked for in so many last characters; where these hold too few, in the whole text.
TAIL = 400
KINDS = ("word", "phrase", "limit", "closing", "hunk", "mark")
FOUND = ("word", "phrase", "open", "closing", "hunk", "mark")
#: Marks of omission.
MARKS = (" [truncated]", "[truncated]", "...", "\u2026")
WORD_TIMES, WORD_LEAST = 8, 3
PAIR_WORD_TIMES, PAIR_WORD_LEAST = 20, 10
PHRASE_LEAST, PHRASE_SHARE = 12, 0.02
PAIR_LEAST, PAIR_SHARE = 40, 0.01
CLOSING_SHARE, CLOSING_LEAST = 0.9, 30
LIMIT_TIMES, LIMIT_STEP, LIMIT_LEAST, LIMIT_SPAN, LIMIT_TAIL, SHORTEST_LIMIT = 5, 4, 8, 20, 40, 60
#: Share of texts that have a limit's length by chance up to which the length alone counts as `limit`.
CHANCE = 0.05
#: Rows of the table of limits, and sources, up to which they are broadcast.
MOST_LIMITS = 50_000
#: A trigram (or pair) that is met so often elsewhere, with such a share of ends, usually ends a text or line.
USUAL_LEAST, USUAL_END = 3, 0.3


def plain(text: Column) -> Column:
    """The text with one kind of line end; a JSON object's escapes are resolved."""
    resolved = F.replace(F.replace(F.replace(text, F.lit("\\r\\n"), F.lit("\n")), F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"'))
    resolved = F.replace(F.replace(resolved, F.lit("\\t"), F.lit("\t")), F.lit("\\\\"), F.lit("\\"))
    return F.replace(F.replace(F.when(text.startswith('{"'), resolved).otherwise(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def tokens(text: Column) -> Column:
    """Words and single marks; runs of data, hashes, numbers, runs of blanks and marks that end a sentence are each one kind."""
    for pattern, stands in ((DATA_RUN, RUN), (HASH, "#"), (r"\p{N}+", "0"), (r"[ \t]{2,}", "  "), (r"[.!?](?=\s|$)", STOP)):
        text = F.regexp_replace(text, pattern, stands)
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"))


def _tail(text: Column) -> Column:
    """Tokens of the text's last characters, from the first blank in them on if that isn't the whole text."""
    return tokens(F.when(F.length(text) <= TAIL, F.concat(F.lit("\n"), text)).otherwise(F.regexp_replace(F.right(text, F.lit(TAIL)), r"\A\S*", "")))


def _last(tail: str, text: Column) -> Column:
    """The last three tokens a, b, c of the text ('' for none); a line end stands before the first one.

    They are those of the whole text, which is read where `tail` isn't four tokens, the first of which may be incomplete.
    """
    found = F.when((F.size(tail) >= 4) | (F.length(text) <= TAIL), F.col(tail)).otherwise(tokens(F.concat(F.lit("\n"), text)))
    # Padded in front, so that there always are three.
    three = F.slice(F.concat(F.array(F.lit(""), F.lit("")), found), -3, 3)
    return F.struct(*(three[i].alias(x) for i, x in enumerate("abc")))


def _hunk_missing(text: Column) -> Column:
    """Whether the last hunk of a diff is shorter than its header says; null if there is none."""
    hunk = F.substring_index(F.concat(F.lit("\n"), text), "\n@@ -", -1)
    header = r"^([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"
    old, new = (F.coalesce(F.expr(f"try_cast(nullif(regexp_extract(_hunk, r'{header}', {i}), '') as int)"), F.lit(1)) for i in (2, 4))
    lines = F.slice(F.split(F.col("_hunk"), "\n"), 2, 1 << 30)
    body = F.filter(lines, lambda x: ~x.startswith("\\"))
    # The last line may itself be cut; an empty one is what follows the final line end.
    count = lambda marks: F.size(F.filter(body, lambda x: F.substring(x, 1, 1).isin(*marks)))
    short = (count([" ", "-"]) < old) | (count([" ", "+"]) < new)
    return hunk, F.when(F.col("_hunk").rlike(header) & ~F.col("_hunk").contains("\ndiff --git "), short)


def endings(documents: DataFrame) -> DataFrame:
    """One row a document with a text that is not blank: its key, lengths, hunk, and last three tokens a, b, c ('' for
    none), as (last) and without a mark of omission (bare)."""
    text = plain(F.col("text"))
    rows = documents.where(F.col("text").rlike(r"[^\s\p{Z}]")).select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("source"),
        F.md5("text").alias("key"),
        F.length("text").alias("chars"),
        F.octet_length("text").alias("bytes"),
        text.alias("_text"),
    )
    hunk, missing = _hunk_missing(F.col("_text"))
    mark = F.coalesce(*(F.when(F.endswith("_text", F.lit(m)), F.lit(m)) for m in MARKS))
    bare = F.left("_text", F.length("_text") - F.length("mark"))

    return (
        rows.withColumns({"_hunk": hunk, "mark": mark})
        .withColumn("_bare", F.when(F.col("mark").isNotNull(), bare))
        .withColumns({"_tail": _tail(F.col("_text")), "_bare_tail": F.when(F.col("mark").isNotNull(), _tail(F.col("_bare")))})
        .select(
            "doc_id", "source", "key", "chars", "bytes", "mark",
            missing.alias("short_hunk"),
            F.md5(F.regexp_replace(F.expr(f"right(_text, {LIMIT_TAIL})"), "[0-9]+", "0")).alias("tail"),
            _last("_tail", F.col("_text")).alias("last"),
            F.when(F.col("mark").isNotNull(), _last("_bare_tail", F.col("_bare"))).alias("bare"),
        )
    )


def inner_trigrams(documents: DataFrame) -> DataFrame:
    """(a, b, c, n, ends): each trigram of tokens inside the texts, how often it occurs and how often a line ends there.

    A text's last trigram isn't counted here.
    """
    t = spread(documents.select("text")).where("text is not null").select(
        F.concat(F.array(F.lit("\n")), tokens(plain(F.col("text")))).alias("t")
    )
    size = F.size("t")
    part = lambda i: F.slice(F.col("t"), i, F.greatest(size - 3, F.lit(0)))
    rows = t.select(
        F.inline(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), part(4).alias("d")))
    ).toDF("a", "b", "c", "d")
    return rows.groupBy("a", "b", "c").agg(
        F.count("*").alias("n"), F.sum((F.col("d") == "\n").cast("bigint")).alias("ends")
    )


def _successors(inner: DataFrame, finals: DataFrame, before: list[str]) -> DataFrame:
    """(before, c, last, inside, line_ends, longer): for each final token c after the tokens `before`, how often it, and
    how often longer tokens that begin with it, come after them inside texts.

    inner: before, c, n, ends; finals: before, c, last. Longer tokens follow c in order of bytes, so both sums are
    differences of one running sum over the tokens that begin with the same character: no token meets another one.
    """
    letter = F.substring("c", 1, 1).alias("l")
    zero = F.lit(0).cast("bigint")
    rows = inner.select(*before, "c", letter, "n", "ends", zero.alias("last"))
    rows = rows.unionByName(finals.select(*before, "c", letter, zero.alias("n"), zero.alias("ends"), "last"))
    # One shuffle, by what the window needs, serves both aggregates too.
    rows = rows.repartition(width(inner.sparkSession), *before, "l")
    rows = rows.groupBy(*before, "l", "c").agg(*(F.sum(x).alias(x) for x in ("n", "ends", "last")))
    # After the last text that begins with c, in order of bytes.
    end = F.struct(F.concat("c", F.lit("\U0010ffff")).alias("at"), zero.alias("n"), F.lit(True).alias("is_end"))
    own = F.struct(F.col("c").alias("at"), F.col("n"), F.lit(False).alias("is_end"))
    events = rows.withColumn("e", F.explode(F.when(F.col("last") > 0, F.array(own, end)).otherwise(F.array(own))))
    upto = Window.partitionBy(*before, "l").orderBy("e.at").rangeBetween(Window.unboundedPreceding, 0)
    summed = events.withColumn("upto", F.sum("e.n").over(upto)).where("last > 0")
    pick = lambda at_end: F.max(F.when(F.col("e.is_end") == at_end, F.col("upto")))
    return (
        summed.groupBy(*before, "l", "c")
        .agg(F.max("last").alias("last"), F.max("n").alias("inside"), F.max("ends").alias("line_ends"), (pick(True) - pick(False)).alias("longer"))
        .drop("l")
    )


def _limits(texts: DataFrame) -> DataFrame:
    """(source, unit, at, chance): lengths that far more texts of a source have than the lengths around, and the share
    of those texts that has it by chance. Source '' has the limits of all sources."""
    lengths = texts.select(
        "source",
        "tail",
        F.explode(F.create_map(F.lit("chars"), F.col("chars"), F.lit("bytes"), F.col("bytes"))).alias("unit", "at"),
    )
    counts = cut(lengths.distinct().groupBy("source", "unit", "at").agg(F.count("*").alias("n")))
    near = counts.select("source", "unit", "n", F.explode(F.sequence(F.col("at") - LIMIT_SPAN, F.col("at") + LIMIT_SPAN)).alias("to"), "at").where("to <> at")
    around = near.groupBy("source", "unit", F.col("to").alias("at")).agg(
        (F.sum("n") / (2 * LIMIT_SPAN)).alias("usual"),
        F.max(F.when(F.col("to") - near["at"] <= 3, F.when(F.col("to") > near["at"], F.col("n")))).alias("before"),
    )
    # A limit in characters also shows in bytes, and the other way round, by the texts of one byte a character.
    limits = (
        counts.where((F.col("n") >= LIMIT_LEAST) & (F.col("at") >= SHORTEST_LIMIT))
        .join(around, ["source", "unit", "at"], "left")
        .withColumns({"usual": F.coalesce("usual", F.lit(0.0)), "before": F.coalesce("before", F.lit(0))})
        .where((F.col("n") >= LIMIT_TIMES * F.greatest("usual", F.lit(1.0))) & (F.col("n") >= LIMIT_STEP * F.col("before")))
        .groupBy("source", "at")
        .agg(F.max_by(F.struct("unit", (F.col("usual") / F.col("n")).alias("chance")), F.struct("n", "unit")).alias("l"))
        .select("source", "at", "l.unit", "l.chance")
    )
    # A text without a source may come from any: what isn't beyond the usual at a limit's length came there by chance.
    beyond_usual = limits.join(counts, ["source", "unit", "at"]).where("source <> ''").groupBy("unit", "at").agg(
        F.sum(F.col("n") * (1 - F.col("chance"))).alias("beyond")
    )
    all_sources = counts.where("source <> ''").groupBy("unit", "at").agg(F.sum("n").alias("n"))
    nameless = beyond_usual.join(all_sources, ["unit", "at"]).select(
        F.lit("").alias("source"), "at", "unit", (1 - F.col("beyond") / F.col("n")).alias("chance")
    )
    return cut(limits.unionByName(nameless).groupBy("source", "at", "unit").agg(F.min("chance").alias("chance")))


def _of_sources(texts: DataFrame) -> DataFrame:
    """One row a text (key): its tokens last, without its mark if that stands at a limit; what its sources say of it."""
    # Two tokens that close nearly all texts of a source, blanks and line ends aside.
    sizes = texts.groupBy("source").agg(F.count("*").alias("texts"))
    closing = texts.groupBy("source", F.col("last.b").alias("close_b"), F.col("last.c").alias("close_c")).agg(F.count("*").alias("n"))
    closing = (
        closing.join(sizes, "source")
        .where((F.col("texts") >= CLOSING_LEAST) & (F.col("n") >= F.col("texts") * CLOSING_SHARE))
        .select("source", "close_b", "close_c")
    )
    limits = _limits(texts)
    # Tables of a few numbers a row; each row stands for at least LIMIT_LEAST texts. Broadcast up to a checked size.
    small = F.broadcast if limits.count() <= MOST_LIMITS else (lambda x: x)
    rows = texts.withColumns(
        {
            "chars_bare": F.col("chars") - F.length(F.coalesce("mark", F.lit(""))),
            "bytes_bare": F.col("bytes") - F.octet_length(F.coalesce("mark", F.lit(""))),
        }
    ).join(small(closing) if sizes.count() <= MOST_LIMITS else closing, "source", "left")
    for column in ("chars", "bytes", "chars_bare", "bytes_bare"):
        of_unit = limits.where(F.col("unit") == column[:5]).select("source", F.col("at").alias(column), F.col("chance").alias(f"{column}_chance"))
        rows = rows.join(small(of_unit), ["source", column], "left")
    at_mark = F.col("mark").isNotNull() & F.coalesce("chars_bare_chance", "bytes_bare_chance").isNotNull()
    closed = (F.col("last.b") == F.col("close_b")) & (F.col("last.c") == F.col("close_c"))
    # What a source's limit or closing says of a text holds for its copies under all sources.
    return rows.groupBy("key").agg(
        F.sum("copies").alias("copies"),
        F.first("last").alias("last"),
        F.first("bare").alias("bare"),
        F.max("short_hunk").alias("short_hunk"),
        F.min(F.least("chars_chance", "bytes_chance")).alias("chance"),
        F.max(at_mark).alias("mark"),
        F.max(F.col("close_c").isNotNull() & ~closed).alias("closing"),
    )


def evidence(documents: DataFrame) -> DataFrame:
    """(doc_id, source, the KINDS of evidence, and open) for each document whose text is neither null nor blank.

    documents: doc_id, text, source. Copies of a text get the same evidence, whatever their sources, and count once a
    source where different texts are counted; a null source counts as one of its own, to which the limits of all others
    apply too; empty, blank and null texts have no row; an empty table gives none; other columns are ignored.
    """
    docs = cut(endings(documents.select("doc_id", "text", "source")))
    any_ = [F.first(c).alias(c) for c in ("chars", "bytes", "mark", "short_hunk", "tail", "last", "bare")]
    texts = docs.groupBy("source", "key").agg(F.count("*").alias("copies"), *any_)
    end = F.when(F.col("mark"), F.coalesce("bare", "last")).otherwise(F.col("last"))
    texts = cut(_of_sources(texts).withColumn("end", end).select("*", "end.*").drop("end", "last", "bare"))
    inner = cut(inner_trigrams(documents))

    # At most as many as there are texts, and in bytes far less than the trigrams inside.
    finals = cut(texts.groupBy("a", "b", "c").agg(F.count("*").alias("last")))
    threes = _successors(inner, finals, ["a", "b"])
    pair_sums = inner.groupBy("b", "c").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    twos = _successors(pair_sums, finals.groupBy("b", "c").agg(F.sum("last").alias("last")), ["b"])
    twos = twos.select("b", "c", *(F.col(x).alias(f"pair_{x}") for x in ("last", "inside", "line_ends", "longer")))
    judged = threes.join(twos, ["b", "c"])

    def rare_end(of: str, least: int, share: float) -> Column:
        total = F.col(f"{of}inside") + F.col(f"{of}last")
        return (total >= least) & (F.col(f"{of}line_ends") + F.col(f"{of}last") < total * share)

    def begins(of: str, least: int, times: int) -> Column:
        return (F.col(f"{of}longer") >= least) & (F.col(f"{of}longer") >= times * (F.col(f"{of}inside") + F.col(f"{of}last") - 1))

    def ends(of: str) -> Column:
        """Share of ends among where it is met elsewhere; null if that is too rarely."""
        total = F.col(f"{of}inside") + F.col(f"{of}last") - 1
        return F.when(total >= USUAL_LEAST, (F.col(f"{of}line_ends") + F.col(f"{of}last") - 1) / total)

    # After a line's end or blanks nothing is begun, and the pieces of data say nothing.
    silent = F.col("c").isin("\n", "  ", RUN)
    frequent = F.col("inside") + F.col("last") >= PHRASE_LEAST
    phrase = ~silent & (rare_end("", PHRASE_LEAST, PHRASE_SHARE) | (~frequent & rare_end("pair_", PAIR_LEAST, PAIR_SHARE)))
    a_word = F.col("c").rlike(r"\p{L}$") & (F.col("c") != "#")
    word = ~silent & a_word & (begins("", WORD_LEAST, WORD_TIMES) | begins("pair_", PAIR_WORD_LEAST, PAIR_WORD_TIMES))
    usual = (F.col("c") == "\n") | ((F.col("c") != RUN) & (F.coalesce(ends(""), ends("pair_"), F.lit(0.0)) >= USUAL_END))
    judged = cut(judged.select(F.struct("a", "b", "c").alias("end"), "last", word.alias("word"), phrase.alias("phrase"), usual.alias("usual_end")))

    total = texts.count()
    of_text = lookup(texts.withColumn("end", F.struct("a", "b", "c")), "end", judged, "last", total).select(
        "key",
        "copies",
        "word",
        "phrase",
        F.coalesce((F.col("chance") <= CHANCE) | ((F.col("chance") <= 1 / LIMIT_TIMES) & ~F.col("usual_end")), F.lit(False)).alias("limit"),
        "closing",
        F.coalesce("short_hunk", F.lit(False)).alias("hunk"),
        "mark",
        F.coalesce((F.col("chance") <= 1 / LIMIT_TIMES) & ~F.col("usual_end"), F.lit(False)).alias("open"),
    )
    return lookup(docs.select("doc_id", "source", "key"), "key", cut(of_text), "copies", docs.count()).select("doc_id", "source", *KINDS, "open")


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id) of every document whose text is cut."""
    return evidence(documents).where(" or ".join(FOUND)).select("doc_id")


def truncation_report(documents: DataFrame) -> DataFrame:
    """(source, documents, cut, share) of the documents whose text is neither null nor blank; '' stands for no source."""
    cut_ = F.expr(" or ".join(FOUND))
    return (
        evidence(documents)
        .groupBy("source")
        .agg(F.count("*").alias("documents"), F.sum(cut_.cast("bigint")).alias("cut"))
        .withColumn("share", F.round(F.col("cut") / F.col("documents"), 6))
    )
