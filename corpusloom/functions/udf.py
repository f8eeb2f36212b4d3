"""The few functions that Catalyst can't express, as Arrow UDFs that hold one text at a time besides their batch.

Texts that a function would leave as they are don't go to Python: a pattern tells them apart first."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.config import ChunkConfig

# Byte pairs that UTF-8 text shows when read as an 8-bit code page.
MOJIBAKE_MARKERS = ("Ã", "Â", "Ä", "Æ", "Ê", "áº", "á»", "Ä\u0091", "Ä‘", "Ä\u0090")
ENCODED_RUN = re.compile("[\u0000-ÿ‘’“”…‹›]+")
C1 = re.compile("[\u0080-\u009f]")
LETTERS = re.compile("[À-ỹ]")
#: Texts that begin and end with an ASCII sign that no one takes for white space.
PLAIN_ENDS = r"\A[!-~]{2}\z"
#: Breakpoints of the splitter, the most wanted first.
BREAKS = ("\n\n", "\n", ". ", "; ", ": ", ", ", " ")


#: Code points that composition may change or join with others, in wide ranges: no text without them differs from its NFC.
COMPOSED = "[\u0300-\u036f\u0374\u037e\u0387\u0483-\u0487\u0590-\u1dff\u1f00-\u200f\u20d0-\u20ff\u2126-\u212b\u2300-\u23ff\u2a00-\u2dff\u3000-\u30ff\ua600-\uabff\ud7a4-\U0010ffff]"
#: The same for Java, which asks a class's parts in turn: one part for most letters. And what traces of a wrong code page
#: begin with, besides the two of three letters.
COMPOSED_JAVA = f"[[\u0300-\U0010ffff]&&{COMPOSED}]"
MARKED = "ÃÂÄÆÊ" + "".join(map(chr, range(0x80, 0xA0)))
#: Rows of one piece of a function's results.
PIECE = 128


def arrow(kind: str, one) -> Callable[[Column], Column]:
    """An Arrow UDF over one column, made when it is used: workers import this module without a session. Values are taken
    from the batch one by one; a piece whose texts all stay the same is the batch's own."""

    def run(a: pa.Array) -> pa.Array:
        out, parts = run.type, []
        if a.null_count == len(a) and one(None) is None:
            return pa.nulls(len(a), out)
        for at in range(0, len(a), PIECE):
            part = a.slice(at, PIECE)
            old = part.to_pylist()
            new = [one(x) for x in old]
            parts.append(part if part.type == out and all(x is y for x, y in zip(old, new, strict=True)) else pa.array(new, out))
        return pa.concat_arrays(parts) if parts else pa.array([], out)

    run.type = ARROW[kind]
    run.__annotations__ = {"a": pa.Array, "return": pa.Array}
    return lambda c: F.arrow_udf(run, returnType=kind)(c)


SPAN = "array<struct<start: int, end: int>>"
ARROW = {"string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), SPAN: pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))}


def where_it_matters(change: Callable[[Column], Column], c: Column, matters: Column) -> Column:
    """change(c), made only for the texts that it may alter."""
    return F.coalesce(change(F.when(matters, c)), c)


def beyond_ascii(c: Column) -> Column:
    return F.octet_length(c) > F.length(c)


def may_compose(c: Column) -> Column:
    return beyond_ascii(c) & c.rlike(COMPOSED_JAVA)


def may_be_marked(c: Column, more: str = "") -> Column:
    return beyond_ascii(c) & (c.rlike(f"[{MARKED}{more}]") | F.contains(c, F.lit("áº")) | F.contains(c, F.lit("á»")))


def composed(x: str | None) -> str | None:
    return x if x is None or unicodedata.is_normalized("NFC", x) else unicodedata.normalize("NFC", x)


def nfc(c: Column) -> Column:
    return where_it_matters(arrow("string", composed), c, may_compose(c))


def quality(text: str) -> int:
    """Accented letters count for a text, traces of a wrong code page ten times against it."""
    traces = sum(text.count(m) for m in MOJIBAKE_MARKERS) + len(C1.findall(text))
    return len(LETTERS.findall(text)) - 10 * traces


def redecode(text: str) -> str:
    options = [text]
    for code in ("latin1", "cp1252"):
        try:
            options.append(text.encode(code).decode("utf-8"))
        except UnicodeError:
            pass
    return max(options, key=quality)  # the earliest of equal ones


def repair(text: str | None) -> str | None:
    if text is None or not (any(m in text for m in MOJIBAKE_MARKERS) or C1.search(text)):
        return text
    whole = redecode(text)
    return whole if whole != text else ENCODED_RUN.sub(lambda m: redecode(m[0]), text)


def repair_mojibake(c: Column) -> Column:
    return where_it_matters(arrow("string", repair), c, may_be_marked(c))


def mended(c: Column) -> Column:
    """Both, the repair first."""
    return where_it_matters(arrow("string", lambda x: composed(repair(x))), c, may_be_marked(c, COMPOSED_JAVA))


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    part = text[start:end]
    return end - len(part.lstrip()), start + len(part.rstrip())


def long_spans(text: str, config: ChunkConfig) -> list[tuple[int, int]]:
    """Overlapping spans of at most max_chars that end at the best breakpoint of their later half; a short last
    span joins the one before it (which may then exceed max_chars)."""
    size, spans, start = len(text), [], 0
    while start < size:
        limit = min(start + config.max_chars, size)
        end = limit
        if limit < size:
            earliest = min(limit, start + max(config.min_chunk_chars, config.max_chars // 2))
            end = next((at + len(mark) for mark in BREAKS if (at := text.rfind(mark, earliest, limit)) >= 0), limit)
        last = end >= size
        begin, end = trimmed(text, start, end) if text[start:end].strip() else (start, start)
        if end <= begin:
            begin, end = (begin if begin > start else end), min(start + config.max_chars, size)
        spans.append((begin, end))
        if last or end >= size:
            break
        back = max(0, end - config.overlap_chars)
        start = back if back > begin else end
    if len(spans) > 1 and config.min_chunk_chars and spans[-1][1] - spans[-1][0] < config.min_chunk_chars:
        spans[-2:] = [trimmed(text, spans[-2][0], spans[-1][1])]
    return spans


def split_long(text: Column, config: ChunkConfig = ChunkConfig()) -> Column:
    """array<struct<start, end>> of a text's spans; one span where it fits, which needs no Python where its ends are plain."""
    spans = lambda x: None if x is None else [{"start": a, "end": b} for a, b in long_spans(x, config)]
    fits = (F.length(text) <= config.max_chars) & F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1)).rlike(PLAIN_ENDS)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end"))).cast(SPAN)
    return F.when(fits, whole).otherwise(arrow(SPAN, spans)(F.when(~F.coalesce(fits, F.lit(False)), text)))


def json_object_complete(text: str) -> bool:
    """Whether a whole JSON object has appeared, as a stop rule for generation."""
    depth, quoted, escaped, opened = 0, False, False, False
    for c in text[text.find("{") :] if "{" in text else "":
        if quoted:
            quoted, escaped = (not (c == '"' and not escaped)), (c == "\\" and not escaped)
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            opened = True
            if opened and depth == 0:
                return True
    return False


json_complete = arrow("boolean", lambda x: x is not None and json_object_complete(x))


def segment(backend: str, text: str) -> list[str]:
    """A segmenter's words; a word of several syllables is one token."""
    if backend == "underthesea":
        from underthesea import word_tokenize

        return word_tokenize(text, format="text").split()
    from pyvi import ViTokenizer

    return ViTokenizer.tokenize(text).split()


def segmented(backend: str) -> Callable[[Column], Column]:
    return arrow("array<string>", lambda x: None if x is None else [w for w in segment(backend, x) if re.search(r"\w", w)])
