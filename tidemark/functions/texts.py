"""Text operators over canonical documents, in DataFrame functions: blocks, headings, occurrences, slices, spans.

Offsets are code points, half open."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHOWN = r"(?U)\S"


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (number), text, start, end of every line."""
    return _measured(docs, key, text).drop("_shown")


def _measured(docs: DataFrame, key: str, text: str) -> DataFrame:
    """lines, and whether each is _shown. All that needs the text is taken before the window, so where only spans are read no text is shuffled."""
    each = docs.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line", "text")).withColumns({"_size": F.length("text"), "_shown": F.col("text").rlike(SHOWN)})
    before = F.sum(F.col("_size") + 1).over(Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    return each.withColumn("start", F.coalesce(before, F.lit(0)).cast("int")).select(key, "line", "text", "start", (F.col("start") + F.col("_size")).cast("int").alias("end"), "_shown")


def annotate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A block for every line that is not blank: block_id b000001 and on, its text and span."""
    shown = _measured(docs, key, text).where("_shown")
    number = F.row_number().over(Window.partitionBy(key).orderBy("line"))
    return shown.select(key, F.concat(F.lit("b"), F.lpad(number.cast("string"), 6, "0")).alias("block_id"), "text", "start", "end")


def block_intervals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Maximal runs of lines that are not blank."""
    order = Window.partitionBy(key).orderBy("line")
    shown = _measured(docs, key, text).withColumn("_run", F.sum((~F.col("_shown")).cast("int")).over(order)).where("_shown")
    return shown.groupBy(key, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def occurrences(docs: DataFrame, needle: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Start offsets of all occurrences, overlapping ones too: the text is split before each, and the parts' lengths add up."""
    literal = "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in needle)
    parts = docs.where(F.col(text).contains(needle)).select(key, F.posexplode(F.split(F.col(text), f"(?={literal})", -1)).alias("part", "piece"), F.col(text).startswith(needle).alias("_at_0"))
    at = F.sum(F.length("piece")).over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    found = parts.withColumn("start", F.coalesce(at, F.lit(0)).cast("int"))
    return found.where((F.col("part") > 0) | F.col("_at_0")).select(key, "start")


def line_column(text: Column, offset: Column) -> tuple[Column, Column]:
    """1-based line and column of an offset."""
    before = F.substring(text, F.lit(1), offset)
    last = F.length(F.substring_index(before, "\n", -1))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1, last + 1


def text_slice(text: Column, start: int | None, end: int | None) -> Column:
    """Python's slice rules: open ends, negative offsets from the end, out-of-range ones clamped."""
    n = F.length(text)
    place = lambda k, default: default if k is None else F.lit(k) if k >= 0 else F.greatest(n + k, F.lit(0))
    a, b = place(start, F.lit(0)), F.least(place(end, n), n)
    return F.substring(text, a + 1, F.greatest(b - a, F.lit(0)))


def is_heading(text: Column) -> Column:
    """An ATX line, or a line that is nothing but short bold text."""
    return text.rlike(r"(?U)^#{1,6}\s+\S") | text.rlike(r"(?U)^\*\*[^*\n]{1,80}\*\*:?\s*$")


def heading_label(text: Column) -> Column:
    """A heading's words: without marks, one emphasis around all of it, and a colon; null if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"(?U)^#{1,6}\s+", ""), r"(?U)\s+#+\s*$", "")
    bare = F.trim(F.regexp_replace(bare, ":$", ""))
    unwrapped = bare
    for mark, inner in ((r"\*\*", r"(?:(?!\*\*).)+"), ("__", "(?:(?!__).)+"), (r"\*", "[^*]+"), ("_", "[^_]+")):
        whole = f"^{mark}({inner}){mark}$"
        unwrapped = F.when(bare.rlike(whole) & (unwrapped == bare), F.trim(F.regexp_extract(bare, whole, 1))).otherwise(unwrapped)
    label = F.trim(F.regexp_replace(unwrapped, ":$", ""))
    return F.when(label != "", label)


def under_headings(blocks: DataFrame, key: str = "doc_id", heading: Column | None = None, label: Column | None = None) -> DataFrame:
    """Each block with section_heading: the label of the last heading at or before it; an empty label ends a section."""
    heading = is_heading(F.col("text")) if heading is None else heading
    label = heading_label(F.col("text")) if label is None else label
    so_far = Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(F.when(heading, F.struct(label.alias("label"))), True).over(so_far)
    return blocks.withColumn("section_heading", carried["label"])


def repeated_lines(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Blocks whose text occurs again in their document: the text, its blocks in order."""
    return blocks.groupBy(key, "text").agg(F.count("*").alias("n"), F.min("block_id").alias("first_block"), F.max("block_id").alias("last_block")).where("n > 1")


def merged_length(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Total length of the union of spans (start, end)."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    add = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(reach, F.col("start"))), F.lit(0))
    return spans.withColumn("_add", add).groupBy(*keys).agg(F.sum("_add").cast("long").alias("covered"))


def span_jaccard(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    both = F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0))
    either = (a_end - a_start) + (b_end - b_start) - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


#: Single characters and the plain ones they stand for.
TYPOGRAPHIC = {
    "\u2018": "'", "\u2019": "'", "\u201a": "'", "\u201b": "'",
    "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u201f": '"',
    "\u2012": "-", "\u2013": "-", "\u2014": "-", "\u2212": "-",
    "\u00a0": " ", "\u2009": " ", "\u202f": " ",
}
#: Compounds that are one skill, in lower case.
WHOLE_MENTIONS = ["ci/cd", "tcp/ip", "i/o", "ui/ux", "a/b", "pl/sql"]


def typographic_fold(text: Column) -> Column:
    """Quotes, dashes and spaces in their plain form, one for one, so offsets stay."""
    return F.translate(text, "".join(TYPOGRAPHIC), "".join(TYPOGRAPHIC.values()))


def case_fold(text: Column) -> Column:
    """Full case folding: upper case and back, so that a sharp s becomes two letters; the dotless i and the final sigma are put right."""
    raised = F.upper(F.translate(F.replace(text, F.lit("ẞ"), F.lit("ss")), "ı", "\ue000"))
    return F.translate(F.lower(F.translate(raised, "\ue000", "ı")), "ς", "σ")


def split_mention(name: Column) -> Column:
    """The mentions that one written mention stands for.

    A closing parenthesis and edge punctuation go. A slash (or " and/or ") parts it only if every part stands alone: none is empty,
    a number, or of several words. Null and empty: no mention."""
    single = F.trim(F.regexp_replace(name, r"(?U)\s+", " "))
    bare = F.btrim(F.regexp_replace(single, r"\s*\([^()]*\)\s*$", ""), F.lit(" .,;:"))
    parts = F.transform(F.split(F.replace(bare, F.lit(" and/or "), F.lit("/")), "/", -1), lambda x: F.trim(x))
    together = F.lower(bare).isin(WHOLE_MENTIONS) | F.exists(parts, lambda x: (x == "") | x.contains(" ") | x.rlike(r"(?U)^\d+$"))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).when(together, F.array(bare)).otherwise(parts)


_TERM = re.compile(r"[\w+#./&]+")


def term_matches(text: str, vocabulary: dict[str, str], most_words: int = 5) -> list[tuple[str, int, int]]:
    """Leftmost-longest dictionary matches over word windows: (name, start, end). Keys are case-folded, single-spaced.

    A key whose words are not all somewhere in the text is no match; most texts hold no key's words and are not cut into words at all."""
    folded, sizes = text.casefold(), {}
    for key in vocabulary:
        parts = key.split(" ")
        if len(parts) <= most_words and all(p in folded for p in parts):
            sizes.setdefault(parts[0], set()).add(len(parts))
    if not sizes:
        return []
    found = [(m[0].rstrip("./&"), m.start()) for m in _TERM.finditer(text)]
    words = [w.casefold() for w, _ in found]
    out, i = [], 0
    while i < len(words):
        for n in sorted(sizes.get(words[i], ()), reverse=True):
            name = vocabulary.get(" ".join(words[i : i + n])) if i + n <= len(words) else None
            if name is not None:
                last, at = found[i + n - 1]
                out.append((name, found[i][1], at + len(last)))
                i += n
                break
        else:
            i += 1
    return out
