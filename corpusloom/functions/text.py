"""String functions, Column to Column; the only place with the text patterns.

Java's patterns see only ASCII in \\w, \\s, \\d and \\b without (?U), and only ASCII letters with (?i) without (?u).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.config import TokenizerConfig

from .udf import beyond_ascii, mended, nfc, segmented

# Terms that are also indexed as one token.
PHRASES = (
    "bảo hiểm xã hội", "bảo hiểm y tế", "bảo hiểm thất nghiệp", "bồi thường thiệt hại", "chấm dứt hợp đồng", "chủ sở hữu", "chuyển nhượng cổ phần",
    "chuyển nhượng vốn", "cơ quan nhà nước", "công bố thông tin", "công chức", "công ty cổ phần", "công ty hợp danh", "công ty mẹ",
    "công ty trách nhiệm hữu hạn", "công ty", "đăng ký doanh nghiệp", "đại diện theo pháp luật", "điều lệ công ty", "điều lệ", "đình chỉ hoạt động",
    "doanh nghiệp nhỏ và vừa", "doanh nghiệp tư nhân", "doanh nghiệp", "giao dịch dân sự", "giấy chứng nhận đăng ký doanh nghiệp",
    "giấy chứng nhận quyền sử dụng đất", "góp vốn", "hóa đơn điện tử", "hóa đơn", "hộ kinh doanh", "hợp đồng lao động", "hợp đồng thương mại",
    "hợp đồng", "kê khai thuế", "kiểm tra thuế", "lao động", "mã số doanh nghiệp", "mã số thuế", "người đại diện theo pháp luật", "người lao động",
    "nghĩa vụ thuế", "pháp nhân thương mại", "phạt vi phạm", "quyền sở hữu", "quyền sử dụng đất", "sở hữu trí tuệ", "tạm ngừng kinh doanh",
    "tiền lương", "tranh chấp lao động", "trách nhiệm hữu hạn", "vốn điều lệ", "vốn góp", "xử phạt hành chính",
)
# Abbreviations, reference labels and the pattern of document numbers.
ABBREVIATIONS = (("TNHH", "trách nhiệm hữu hạn"), ("BHXH", "bảo hiểm xã hội"), ("GTGT", "giá trị gia tăng"))
REFERENCES = ((r"điều\s*([0-9]+(?:\.[0-9A-Za-zĐđ]+)*)", "Điều"), (r"khoản\s*([0-9]+)", "Khoản"), (r"điểm\s*([A-Za-zĐđ])", "Điểm"))
DOCUMENT_NUMBER = r"(?iuU)\b(\d+)\s*/\s*(\d{4})\s*/\s*([A-Za-zĐđ]+)\s*-\s*([A-Za-zĐđ]+)\b"
TOKEN = "[0-9A-Za-zÀ-ỹ_]+"
CLAUSE = r"(?mdU)^(?=\d+\.\s+)"
CLAUSE_LABEL = r"(?U)^(\d+)\.\s+"
POINT = r"(?mdiuU)(?=(?:(?<=[\n;:])|^)\s*[a-zđ]\)\s+)"
POINT_LABEL = r"(?iuU)^\s*([a-zđ])\)\s+"


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends (trim() removes U+0020 only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def plain_newlines(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, "﻿ ", "  "), "\r\n?", "\n")


#: What cleaning changes: a text without any of it, once composed, is clean.
UNCLEAN = "(?U)[\t\r\ufeff\u00a0]|  |\n | \n|\n\n\n|\\A\\s|\\s\\z"


def clean_text(c: Column) -> Column:
    """A document's text: NFC, no carriage returns, single blanks, trimmed lines, at most one empty line; null is empty."""

    def cleaned(c: Column) -> Column:
        c = plain_newlines(c)
        c = F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "\n[ \t]+|[ \t]+(?=\n)", "\n")
        c = F.regexp_replace(F.regexp_replace(c, "\n[ \t]+", "\n"), "[ \t]+\n", "\n")
        return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))

    return let(nfc(F.coalesce(c, F.lit(""))), lambda t: F.when(t.rlike(UNCLEAN), cleaned(t)).otherwise(t))


def tokenizer_text(c: Column, config: TokenizerConfig = TokenizerConfig()) -> Column:
    return single_spaced(written(c, config))


def written(c: Column, config: TokenizerConfig) -> Column:
    """Composed, its code page repaired and in lower case, as the settings say; white space as it is."""
    c = F.coalesce(c, F.lit(""))
    c = mended(c) if config.repair_mojibake else nfc(c)
    return F.lower(c) if config.lowercase else c


def single_spaced(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(plain_newlines(c), "[ \t]+", " "), "\n+", "\n"))


def quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def let(value: Column, body) -> Column:
    """body(value), with value computed once: as an array's one element it has a name inside the lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def phrase_tokens(text: Column, phrases: Sequence[str]) -> Column:
    """One token for each phrase of the list that the text holds as whole words, in the list's order. The list is a value that is
    gone through: an expression for each phrase would be a method too long to be compiled. Most texts lack a letter or a word
    of every phrase and are done with; of the others white space is normalised."""
    parts = [p.lower().split() for p in phrases if p.split()]
    if not parts:
        return empty_strings()
    letters = lambda p: 2 if re.search("[^\x00-\xff]", "".join(p)) else 1 if not "".join(p).isascii() else 0
    pattern = lambda p: r"(?U)(?<!\w)" + r"\s+".join(map(quoted, p)) + r"(?!\w)"
    known = F.array(*[F.struct(F.lit(letters(p)).alias("k"), *[F.lit(v).alias(k) for k, v in zip("flpt", (p[0], p[-1], pattern(p), "_".join(p)), strict=True)]) for p in parts])
    have = lambda t: F.when(~beyond_ascii(t), 0).when(~t.rlike("[^\\x00-\\xff]"), 1).otherwise(2)
    near = lambda t: let(have(t), lambda n: F.filter(known, lambda p: (p["k"] <= n) & F.contains(t, p["f"]) & F.contains(t, p["l"])))
    held = lambda some, t: F.transform(F.filter(some, lambda p: F.rlike(t, p["p"])), lambda p: p["t"])
    return let(text, lambda t: let(near(t), lambda some: F.when(F.size(some) > 0, let(single_spaced(t), lambda s: held(some, s))).otherwise(empty_strings())))


def tokenize(c: Column, config: TokenizerConfig = TokenizerConfig()) -> Column:
    """Words, then phrase tokens as often as the boost says. White space of any kind parts words, so only phrases and word
    segmenters need it normalised."""
    phrases = PHRASES if config.phrases is None else config.phrases
    regex = config.resolved == "regex"

    def both(text: Column) -> Column:
        words = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)) if regex else segmented(config.resolved)(text)
        return F.concat(words, F.flatten(F.array_repeat(phrase_tokens(text, phrases), config.phrase_boost))) if config.phrase_boost else words

    return let(written(c, config) if regex else tokenizer_text(c, config), both)


def identity_text(c: Column) -> Column:
    return squeeze(nfc(c))


def rewritten(c: Column, pattern: str, change) -> Column:
    """Every match of the pattern replaced by change(match), all with built-in functions."""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    parts = F.split(c, pattern, -1)
    return F.array_join(F.zip_with(parts, F.transform(found, change), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def query_text(c: Column) -> Column:
    """A question: NFC, single blanks, abbreviations written out, references and document numbers in one form."""
    c = squeeze(nfc(c))
    for short, full in ABBREVIATIONS:
        c = F.regexp_replace(c, rf"(?iuU)\b{short}\b", full)
    for pattern, label in REFERENCES:
        c = F.regexp_replace(c, rf"(?iuU)\b{pattern}", f"{label} $1")
    part = lambda m, g: F.regexp_extract(m, DOCUMENT_NUMBER, g)
    return rewritten(c, DOCUMENT_NUMBER, lambda m: F.concat(part(m, 1), F.lit("/"), part(m, 2), F.lit("/"), F.upper(F.concat(part(m, 3), F.lit("-"), part(m, 4)))))


def word_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(r"(?U)\S+"), F.lit(0))).cast("long")


def char_len(c: Column) -> Column:
    return F.length(c).cast("long")


def strip_punctuation(c: Column) -> Column:
    return F.btrim(c, F.lit(".,;:!?()[]{}\"'"))


def joined(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def stable_id(*parts: Column, length: int = 20) -> Column:
    return F.substring(F.sha1(joined(*parts)), 1, length)


def content_id(article_id: Column, text: Column, strict: bool = True) -> Column:
    """Identity of a passage by its article and normalised text. An empty text is an error; unless strict, empty texts of an
    article are the same passage, and a null has no identity."""
    norm = identity_text(text)
    own = F.substring(F.sha2(F.concat_ws("|", F.lit("v2"), F.coalesce(article_id, F.lit("")), norm), 256), 1, 32)
    return F.when(norm != "", own).otherwise(F.raise_error(F.lit("a passage without text has no identity"))) if strict else F.when(norm.isNotNull(), own)


#: The name space of point ids made from addresses (RFC 4122).
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys, nulls kept and nothing escaped beyond need."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


# Labels of the lines before an embedded passage, by column.
EMBEDDING_LABELS = (("subject_title", "Chủ đề"), ("topic_title", "Đề mục"), ("chapter_title", "Chương"), ("article_title", "Điều"), ("clause_number", "Khoản"), ("point_label", "Điểm"), ("source_url", "Nguồn"))


def embedding_text(text: Column, **context: Column) -> Column:
    lines = [F.when(F.coalesce(context[k].cast("string"), F.lit("")) != "", F.concat(F.lit(f"{label}: "), context[k].cast("string"))) for k, label in EMBEDDING_LABELS if k in context]
    passage = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+$", "")  # an empty one keeps its (empty) line
    return F.regexp_replace(F.concat_ws("\n", *lines, F.lit(""), F.lit("Nội dung:"), passage), r"(?U)^\s+", "")


def with_instruction(query: Column, instruction: str) -> Column:
    return F.concat(F.lit(f"Instruct: {instruction}\nQuery: "), query) if instruction.strip() else query


def sparse_query(query: Column, lexical_terms: Column) -> Column:
    """The query with those terms it doesn't contain yet."""
    return F.concat_ws(" ", query, F.filter(F.coalesce(lexical_terms, empty_strings()), lambda t: ~F.contains(F.lower(query), F.lower(t))))


def clause_parts(text: Column) -> Column:
    """array<struct<label, part>> of an article's numbered clauses; what stands before the first has no label."""
    return labelled(text, CLAUSE, CLAUSE_LABEL)


def point_parts(text: Column) -> Column:
    return labelled(text, POINT, POINT_LABEL)


def labelled(text: Column, mark: str, label: str) -> Column:
    parts = F.filter(F.split(text, mark, -1), lambda p: strip(p) != "")
    return F.transform(parts, lambda p: F.struct(F.nullif(F.regexp_extract(p, label, 1), F.lit("")).alias("label"), strip(p).alias("part")))


def legal_segments(text: Column) -> Column:
    """array<struct<kind, clause, point, text>>: clauses, and points inside them. Points of an article without
    clauses are article segments and lose their labels."""

    def inner(c: Column) -> Column:
        points = point_parts(c["part"])
        return F.transform(
            points,
            lambda p: F.struct(
                F.when(c["label"].isNull(), "article").when(p["label"].isNull(), "clause").otherwise("point").alias("kind"),
                c["label"].alias("clause"), F.when(c["label"].isNotNull(), F.lower(p["label"])).alias("point"), p["part"].alias("text"),
            ),
        )

    return F.flatten(F.transform(clause_parts(text), inner))


def whole_segment(text: Column) -> Column:
    """The text as one segment of that form, none where it is blank."""
    none = F.lit(None).cast("string")
    one = F.array(F.struct(F.lit("article").alias("kind"), none.alias("clause"), none.alias("point"), text.alias("text")))
    return F.filter(one, lambda s: strip(s["text"]) != "")


def first_unique(values: Column, n) -> Column:
    return F.slice(F.array_distinct(values), 1, n)


def clean_ids(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(values, strip), lambda x: x.isNotNull() & (x != "")))


def safe_int(c: Column) -> Column:
    return c.try_cast("int")


def safe_float(*cs: Column) -> Column:
    """The first value that is a number, or null."""
    return F.coalesce(*[F.nullif(c.cast("string").try_cast("double"), F.lit(float("nan"))) for c in cs])


def safe_links(c: Column) -> Column:
    """Links given as JSON text; whatever isn't a list of objects is no link."""
    kind = "array<map<string,string>>"
    return F.filter(F.coalesce(F.from_json(c, kind), F.array().cast(kind)), lambda x: x.isNotNull())


def parse_cutoffs(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x).try_cast("int")), lambda x: x > 0)))


def shard_number(path: Column) -> Column:
    """The number after the last underscore of a file name; anything else is an error."""
    return F.regexp_extract(path, r"_(\d+)(?:\.[^./]*)?$", 1).cast("int")


def json_object(c: Column) -> Column:
    """The JSON object inside a model's answer (code fences and words around it dropped), or null."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))
