"""Column expressions on blocks and texts. All are built-in functions."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once a row, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def may_hold(text: Column, words: Sequence[str]) -> Column:
    """Whether one of the words, upper-case ones in any case, is in a text."""
    return bound(F.upper(text), lambda t: functools.reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in words]))


def blank(c: Column | str) -> Column:
    """Null or empty."""
    return F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")) == ""


def clip(c: Column, n: int = fixed.EVIDENCE_CHARS) -> Column:
    return F.substring(c, 1, n)


def trimmed(c: Column) -> Column:
    """Without white space, of any script, at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeezed(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def cells() -> Column:
    return F.concat(F.coalesce("headers", F.array().cast("array<string>")), F.flatten(F.coalesce("rows", F.array().cast("array<array<string>>"))))


def block_text() -> Column:
    """A block's text by its kind. An alt that is empty, but not null, hides the caption."""
    k = F.col("kind")
    return (
        F.when(k.isin("heading", "paragraph", "code", "callout"), F.coalesce("text", F.lit("")))
        .when(k == "list", F.array_join(F.coalesce("items", F.array().cast("array<string>")), " "))
        .when(k == "table", F.array_join(cells(), " "))
        .when(k == "image", F.coalesce("alt", "caption", F.lit("")))
        .when(k == "macro", F.coalesce("rendered_text", F.lit("")))
        .when(k == "slide", F.coalesce("notes", F.lit("")))
        .otherwise("")
    )


def block_markdown() -> Column:
    """A block as markdown, without its id comment."""
    k, nl = F.col("kind"), "\n"
    none, no_rows = F.array().cast("array<string>"), F.array().cast("array<array<string>>")
    items = F.array_join(
        F.transform(
            F.coalesce("items", none),
            lambda x, i: F.concat(F.repeat(F.lit("  "), F.coalesce("depth", F.lit(0))), F.when(F.col("ordered"), F.concat((i + 1).cast("string"), F.lit("."))).otherwise("-"), F.lit(" "), x),
        ),
        nl,
    )
    rows = F.coalesce("rows", no_rows)
    given = F.coalesce("headers", none)
    headers = F.when(F.size(given) > 0, given).otherwise(F.transform(F.coalesce(F.get(rows, F.lit(0)), none), lambda _: F.lit("")))
    line = lambda a: F.concat(F.lit("| "), F.array_join(a, " | "), F.lit(" |"))
    table = F.array_join(
        F.concat(
            F.when(~blank("caption"), F.array(F.concat(F.lit("표: "), "caption"))).otherwise(none),
            F.when(F.size(headers) > 0, F.array(line(headers), line(F.transform(headers, lambda _: F.lit("---"))))).otherwise(none),
            F.transform(rows, line),
        ),
        nl,
    )
    label = F.coalesce("alt", "caption")
    image = F.concat(F.lit("[이미지: "), F.when(blank(label), "alt 없음").otherwise(label), F.lit("]"), F.when(blank("ocr_text"), "").otherwise(F.concat(F.lit(nl), "ocr_text")))
    macro = F.coalesce("rendered_text", F.concat(F.lit("[매크로: "), F.coalesce("name", F.lit("")), F.lit(" — 내용 추출 불가]")))
    slide = F.concat(F.lit("## 슬라이드 "), F.coalesce(F.col("slide_index").cast("string"), F.lit("")), F.when(blank("notes"), "").otherwise(F.concat(F.lit(nl + "발표자 노트: "), "notes")))
    text = F.coalesce("text", F.lit(""))
    return (
        F.when(k == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), text))
        .when(k == "paragraph", text)
        .when(k == "list", items)
        .when(k == "table", table)
        .when(k == "code", F.concat(F.lit("```"), F.coalesce("lang", F.lit("")), F.lit(nl), text, F.lit(nl + "```")))
        .when(k == "image", image)
        .when(k == "callout", F.concat(F.lit("> ["), F.coalesce("variant", F.lit("")), F.lit("] "), text))
        .when(k == "macro", macro)
        .when(k == "slide", slide)
    )


def evidence_found(needle: Column, text: Column) -> Column:
    """Whether a quotation, white space squeezed, is in a text: word for word or, in a text of up to
    FUZZY_CHARS, as a window of the quotation's length that is FUZZY similar by edit distance."""
    n, h = squeezed(F.coalesce(needle, F.lit(""))), squeezed(F.coalesce(text, F.lit("")))
    size = F.length(n)
    last = F.length(h) - size
    off = F.floor(size * (1 - fixed.FUZZY) + 1e-9).cast("int")
    # Of a quotation cut in one piece more than there may be edits, one at least is word for word in a similar window.
    cut = lambda j: F.floor(size * j / (off + 1)).cast("int")
    likely = F.exists(F.sequence(F.lit(0), off), lambda j: F.contains(h, F.substr(n, cut(j) + 1, cut(j + 1) - cut(j))))
    near = F.exists(F.sequence(F.lit(1), F.greatest(last, F.lit(0)) + 1), lambda i: F.call_function("levenshtein", F.substr(h, i, size), n, off) >= 0)
    return F.when(size == 0, False).when(F.contains(h, n), True).when((F.length(h) > fixed.FUZZY_CHARS) | (last < 0), False).when(~likely, False).otherwise(near)


def link_target(href: Column, base_url: Column) -> Column:
    """anchor, attachment, internal or external, in this order of tests."""
    return (
        F.when(F.startswith(href, F.lit("#")), "anchor")
        .when(href.rlike("/download/(attachments|thumbnails)/"), "attachment")
        .when(F.startswith(href, F.lit("/")), "internal")
        .when((base_url != "") & F.startswith(href, base_url), "internal")
        .otherwise("external")
    )


def normal_uri(uri: Column) -> Column:
    """Without fragment, query and slashes at the end, but for a string of one character."""
    cut = F.regexp_replace(uri, "(?s)[#?].*$", "")
    return F.when(F.length(cut) > 1, F.regexp_replace(cut, "/+$", "")).otherwise(cut)


def html_escaped(c: Column) -> Column:
    for raw, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(to))
    return c


def column_number(letters: Column) -> Column:
    """A spreadsheet column's number from 0: A is 0, Z 25, AA 26."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda a, x: a * 26 + F.ascii(x) - 64) - 1


def days_ago(at: Column, now: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.floor((F.unix_millis(now) - F.unix_millis(at)) / 86_400_000))


def anchor_sentence() -> Column:
    """Where an anchor points, as a phrase."""
    a = lambda n: F.col(f"anchor.{n}")
    sheet = F.concat(a("sheet"), F.lit(" 시트"))
    return (
        F.when(F.col("anchor").isNull() | a("kind").isNull(), "문서 전체")
        .when(a("kind") == "pdf", F.concat(a("page").cast("string"), F.lit("쪽")))
        .when(a("kind") == "pptx", F.concat(a("slide").cast("string"), F.lit("번 슬라이드")))
        .when(a("kind") == "xlsx", F.when(a("range").isNull(), sheet).otherwise(F.concat(sheet, F.lit(" "), a("range"))))
        .when(a("kind") == "docx", F.concat((a("paragraph_index") + 1).cast("string"), F.lit("번째 문단")))
        .otherwise(F.concat(F.lit('"'), a("quote_exact"), F.lit('"')))
    )


def status_kind(status: Column) -> Column:
    """Kind of a failed request to the service, by its HTTP status."""
    return F.when(status == 401, "unauthorized").when(status == 403, "forbidden").when(status == 429, "quota").otherwise("server")


def model_error_kind(status: Column, message: Column) -> Column:
    """Kind of a failed model call, by status or message."""
    m = F.coalesce(message, F.lit(""))
    return (
        F.when(status.isin(401, 403) | m.rlike("(?i)api key|unauthorized|permission denied"), "auth")
        .when((status == 429) | m.rlike("(?i)rate limit|quota|resource_exhausted"), "rate-limit")
        .when((status == 504) | m.rlike("(?i)timeout|timed out|deadline"), "timeout")
        .otherwise("unknown")
    )
