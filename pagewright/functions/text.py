"""Text functions: spans with character and byte offsets, keys, word tests, contexts.

All but the three functions marked as Arrow are JVM expressions. Offsets count
from 0; byte offsets refer to UTF-8.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as K

#: Adjacency rules: name and pattern. Fixed values.
ADJACENCY = {
    "punctuation_letter": r"[,;:!?][A-Za-z][A-Za-z0-9]*",
    "period_capital": r"\.[A-Z][A-Za-z0-9]*",
    "lower_upper": r"[\p{L}\p{M}\p{N}_]*[a-z][A-Z][\p{L}\p{M}\p{N}_]*",
}
PUNCTUATION_RULES = ("punctuation_letter", "period_capital")
#: Both punctuation rules at once, touching hits as one: an island of them.
ISLAND = r"(?:[,;:!?][A-Za-z][A-Za-z0-9]*|\.[A-Z][A-Za-z0-9]*)+"
CLUSTER, RUN = r"[\p{L}\p{M}\p{N}_]+", r"[\p{L}\p{M}]+"
CONTEXT = 160

#: Matches whose offsets are summed up in one array before the next is begun.
BLOCK = 64
SPAN = "array<struct<start:int,end:int,start_byte:int,end_byte:int,observed:string>>"


def spans(text: Column, pattern: str) -> Column:
    """Every match of ``pattern`` in order, with its offsets.

    The gaps and the matches of one pattern alternate, so their running lengths are
    the offsets. Null text gives null. Words come from ``letter_runs``, which hides markup too.
    """
    def step(a: Column, x: Column) -> Column:
        c, b = a["c"] + F.length(x["gap"]), a["b"] + F.octet_length(x["gap"])
        ce, be = c + F.length(x["hit"]), b + F.octet_length(x["hit"])
        span = F.struct(c.alias("start"), ce.alias("end"), b.alias("start_byte"), be.alias("end_byte"), x["hit"].alias("observed"))
        return F.struct(ce.alias("c"), be.alias("b"), F.concat(a["out"], F.array(span)).alias("out"))

    def found(z: Column) -> Column:
        hits = z["hits"]

        def block(parts: Column, k: Column) -> Column:
            last = F.element_at(parts, -1)
            start = F.struct(last["c"].alias("c"), last["b"].alias("b"), F.array().cast(SPAN).alias("out"))
            zipped = F.arrays_zip(F.slice(z["gaps"], k * BLOCK + 1, F.lit(BLOCK)).alias("gap"), F.slice(hits, k * BLOCK + 1, F.lit(BLOCK)).alias("hit"))
            whole = F.filter(zipped, lambda x: x["hit"].isNotNull())  # the gap behind the last match
            return F.concat(parts, F.array(F.aggregate(whole, start, step)))

        # blocks, so that appending one span never copies all the spans before it
        blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(hits) - 1) / BLOCK).cast("int")))
        none = F.array(F.struct(F.lit(0).alias("c"), F.lit(0).alias("b"), F.array().cast(SPAN).alias("out")))
        return F.flatten(F.transform(F.aggregate(blocks, none, block), lambda p: p["out"]))

    # a one-entry array, so that the pattern runs once however often its matches are looked at
    once = F.struct(F.split(text, pattern).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.element_at(F.transform(F.array(once), found), 1)


def words(text: Column, least: int = 4) -> Column:
    """The runs of ``least`` letters or more of a text without their offsets, see ``letter_runs``; markup is not looked at."""
    clusters = F.filter(F.regexp_extract_all(text, F.lit(CLUSTER), F.lit(0)), lambda c: ~c.contains("_"))
    runs = F.flatten(F.transform(clusters, lambda c: F.regexp_extract_all(c, F.lit(RUN), F.lit(0))))
    return F.filter(runs, lambda r: F.length(F.regexp_replace(r, r"\p{M}", "")) >= least)


def flatten_text(text: Column) -> Column:
    """White space (any Unicode blank) turned into single spaces, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def whitespace_proposal(observed: Column, triggers: Column) -> Column:
    """One space after ``,;:!?`` before a letter and after a full stop before a capital; null if nothing changes
    or another rule had a part in the finding."""
    fixed = F.regexp_replace(F.regexp_replace(observed, r"([,;:!?])(?=[A-Za-z])", "$1 "), r"\.(?=[A-Z])", ". ")
    mine = (F.size(triggers) > 0) & (F.size(F.array_except(triggers, F.array(*map(F.lit, PUNCTUATION_RULES)))) == 0)
    return F.when(mine & (fixed != observed), fixed)


def ocr_context(text: Column, start: Column, end: Column) -> Column:
    """The text around a span, 160 characters each side, with its byte offsets."""
    first = F.greatest(F.lit(0), start - CONTEXT)
    last = F.least(F.length(text), end + CONTEXT)
    excerpt = F.substring(text, first + 1, last - first)
    before = F.octet_length(F.substring(text, F.lit(1), first))
    return F.struct(before.alias("start_byte"), (before + F.octet_length(excerpt)).alias("end_byte"), excerpt.alias("text"))


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """The bytes from start to end, as text."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), start + 1, end - start), "UTF-8")


def valid_word(word: Column) -> Column:
    """Letters and marks only, with a letter."""
    return F.coalesce(word.rlike(r"^[\p{L}\p{M}]+\z") & word.rlike(r"\p{L}"), F.lit(False))


def plain_apostrophe(word: Column) -> Column:
    return F.lower(F.translate(word, "’", "'"))


# ---- Arrow functions ---------------------------------------------------------


def canonical_of(word: str) -> str:
    """The key of a word: composed (NFC) and case-folded."""
    return word.lower() if word.isascii() else unicodedata.normalize("NFC", word).casefold()


@F.arrow_udf(K.StringType())
def canonical(words: pa.Array) -> pa.Array:
    """``canonical_of`` for a column; null stays null."""
    return pa.array([None if w is None else canonical_of(w) for w in words.to_pylist()], pa.string())


@F.arrow_udf(K.BooleanType())
def composed(words: pa.Array) -> pa.Array:
    """Whether a word is in composed form (NFC)."""
    return pa.array([w is not None and unicodedata.is_normalized("NFC", w) for w in words.to_pylist()], pa.bool_())


#: Markup that hides text: comments, tags, entities, images, link targets, commands. Fixed values.
MARKUP = [re.compile(p, re.S) for p in (
    r"<!--.*?-->",
    r"""</?[A-Za-z][A-Za-z0-9:-]*(?:[^"'<>]|"[^"]*"|'[^']*')*>""",
    r"&(?:#[0-9]+|#x[0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]+);",
    r"!\[[^]\n]*\]\((?:[^()\n]|\([^()\n]*\))*\)",
    r"\]\((?:[^()\n]|\([^()\n]*\))*\)",
    r"\\(?:[A-Za-z@]+|.)",
)]
#: Where a line begins, and a whole fenced block: its mark may not be given up in part, its end is as long a mark or the text's end.
_LINE = r"(?<![^\n\r\x0b\x0c\x1c-\x1e\x85  ])[ \t]{0,3}"
_FENCED = re.compile(rf"{_LINE}(?P<mark>(?P<sign>[`~])(?P=sign){{2,}}+)(?s:.*?)(?:{_LINE}(?P=mark)(?P=sign)*+[ \t]*(?:\r\n|[\r\n]|\Z)|\Z)")
_SUSPECT = re.compile(r"[<&!\]\\`~]")
#: A blank as long in UTF-8 as the sign it hides; none is a letter, mark or number. Fixed values.
_BLANKS = [" ", "\u00a0", "\u2003", "\U0001f600"]


def hidden(text: str) -> list[tuple[int, int]]:
    """The stretches that markup or code hides, disjoint and in order."""
    found = merged([m.span() for pattern in (_FENCED, *MARKUP) for m in pattern.finditer(text)])
    if "`" not in text:
        return found
    starts = [a for a, _ in found]
    ticks = [m.span() for m in re.finditer("`+", text)]
    open_ = [t for t in ticks if not (k := bisect_right(starts, t[0])) or found[k - 1][1] <= t[0]]
    # from the right: the next visible run of the same length, which is where code that starts at a run ends
    ahead: dict[int, int] = {}
    ends = []
    for a, b in reversed(open_):
        ends.append(ahead.get(b - a))
        ahead[b - a] = b
    code, done = [], 0
    for (a, _), end in zip(open_, reversed(ends), strict=True):
        if a >= done and end is not None:
            code.append((a, end))
            done = end
    return merged(found + code)


def merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of stretches, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def blanked(text: str) -> str:
    """The text with every hidden sign replaced by a blank of the same length in characters and bytes."""
    if not _SUSPECT.search(text):
        return text
    out, at = [], 0
    for a, b in hidden(text):
        gone = text[a:b]
        gone = " " * len(gone) if gone.isascii() else "".join(_BLANKS[len(c.encode()) - 1] for c in gone)
        out += [text[at:a], gone]
        at = b
    return "".join([*out, text[at:]])


_CLUSTER, _RUN, _MARK = regex.compile(CLUSTER), regex.compile(RUN), regex.compile(r"\p{M}")
_PLAIN_RUN, _LONG_RUN = re.compile("[A-Za-z]{4,}"), regex.compile(r"[\p{L}\p{M}]{4,}")


def letter_runs(text: str, plain: bool = False) -> list[tuple[int, int, int, int, str]]:
    """The list of ``runs_of``."""
    return list(runs_of(text, plain))


def runs_of(text: str, plain: bool = False) -> Iterator[tuple[int, int, int, int, str]]:
    """``(start, end, start_byte, end_byte, run)`` of visible runs of four letters or more, one after another.

    Runs lie in clusters of letters, marks, numbers and underscores; a cluster with an
    underscore counts as an identifier and has none.
    """
    shown, at, byte = text if plain else blanked(text), 0, 0
    narrow = shown.isascii()
    if "_" not in shown:  # then clusters do not matter: every run of letters and marks is one of its own
        if narrow:
            for m in _PLAIN_RUN.finditer(shown):
                a, b = m.span()
                yield a, b, a, b, m[0]
            return
        for m in _LONG_RUN.finditer(shown):
            run = m[0]
            if not run.isalpha() and len(_MARK.sub("", run)) < 4:
                continue
            first = byte + len(shown[at : m.start()].encode())
            at, byte = m.end(), first + len(run.encode())
            yield m.start(), at, first, byte, run
        return
    for c in _CLUSTER.finditer(shown):
        cluster = c[0]
        if len(cluster) < 4 or "_" in cluster:
            continue
        for a, b in [(0, len(cluster))] if cluster.isalpha() else [m.span() for m in _RUN.finditer(cluster)]:
            run = cluster[a:b]
            if b - a < 4 or (not run.isalpha() and len(_MARK.sub("", run)) < 4):
                continue
            start = c.start() + a
            if narrow:
                first, last = start, start + b - a
            else:
                first = byte + len(shown[at:start].encode())
                last = first + len(run.encode())
            yield start, start + b - a, first, last, run
            at, byte = start + b - a, last


@F.arrow_udf(K.StringType())
def visible_text(texts: pa.Array) -> pa.Array:
    """``blanked`` for a column; null stays null."""
    return pa.array([None if t is None else blanked(t) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(K.StructType([K.StructField("latin", K.BooleanType()), K.StructField("greek", K.BooleanType())]))
def scripts(words: pa.Array) -> pa.Array:
    """Whether a word has letters named Latin, and letters named Greek."""
    out = []
    for w in words.to_pylist():
        names = [unicodedata.name(c, "") for c in w or "" if c.isalpha()]
        out.append({"latin": any("LATIN" in n for n in names), "greek": any("GREEK" in n for n in names)})
    return pa.array(out, pa.struct([("latin", pa.bool_()), ("greek", pa.bool_())]))
