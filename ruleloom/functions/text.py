"""Text templates, URLs, coercions and message parts as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of the rendered texts.
EMBED_LABELS = (("violated_commonsense_rule", "Violated common-sense rule"), ("situation", "Situation"))
RERANK_LABELS = (("situation", "Situation"), ("violated_commonsense_rule", "Violated commonsense rule"))


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def embedding_text(fields: Sequence[tuple[str, str]] = EMBED_LABELS) -> Column:
    """``Label: value`` lines, one for each field, values trimmed."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"{label}: "), F.trim(F.coalesce(F.col(name), F.lit("")))) for name, label in fields))


def rerank_text(fields: Sequence[tuple[str, str]] = RERANK_LABELS, lists: Sequence[tuple[str, str]] = ()) -> Column:
    """As ``embedding_text`` without empty fields; lists are joined by "; "; null if nothing is left."""
    lines = [F.concat(F.lit(f"{label}: "), _filled(F.col(name))) for name, label in fields]
    for name, label in lists:
        items = F.filter(F.transform(F.col(name), lambda x: F.trim(x)), lambda x: x != "")
        lines.append(F.concat(F.lit(f"{label}: "), F.nullif(F.array_join(items, "; "), F.lit(""))))
    return F.nullif(F.concat_ws("\n", *lines), F.lit(""))


def query_text(description: Column, label: str = "Situation") -> Column:
    text = F.trim(description)
    return F.when(F.lower(text).startswith(label.lower() + ":"), text).otherwise(F.concat(F.lit(f"{label}: "), text))


def issue_markdown(title: Column, url: Column, body: Column, placeholder: str = "_No description provided._") -> Column:
    return F.concat(F.lit("# "), F.trim(title), F.lit("\n\nSource URL: "), url, F.lit("\n\n"), F.coalesce(_filled(body), F.lit(placeholder)), F.lit("\n"))


def issue_parts(url: Column) -> Column:
    """struct(owner, repo, number) of a GitHub issue URL, or null."""
    at = r"^https?://(?:www\.)?github\.com/([^/?#]+)/([^/?#]+)/issues/([0-9]+)(?:[/?#].*)?$"
    part = lambda i: F.regexp_extract(url, at, i)
    return F.when(url.rlike(at), F.struct(part(1).alias("owner"), part(2).alias("repo"), part(3).cast("long").alias("number")))


# Where images stand in Markdown and HTML.
IMAGE = r"""(?i)!\[[^\]]*\]\(\s*<?([^)\s>]+)|<img\b[^>]*?\bsrc\s*=\s*["']([^"']+)|^\s*\[[^\]]+\]:\s*<?(https?://\S+\.(?:png|jpe?g|gif|webp|bmp))|(https?://[^\s<>"')]+\.(?:png|jpe?g|gif|webp|bmp)(?:\?[^\s<>"')]*)?)|(https?://(?:user-images\.githubusercontent\.com|github\.com/user-attachments/assets)/[^\s<>"')]+)"""


def image_urls(markdown: Column) -> Column:
    """Image URLs in order of their place, each once, without enclosing <> and closing punctuation.

    One alternation finds every form, so the order needs no offsets.
    """
    found = F.regexp_extract_all(markdown, F.lit(f"({IMAGE})"), F.lit(1))
    url = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"""(?is)^!\[[^\]]*\]\(\s*|^<img\b[^>]*?\bsrc\s*=\s*["']|^\s*\[[^\]]+\]:\s*""", ""), "^<|>$", ""), r"[).,;\]]+$", "")
    return F.array_distinct(F.filter(F.transform(found, url), lambda x: x != ""))


def fill_template(template: str, placeholder: str, value: Column) -> Column:
    """The template with its one placeholder replaced; an error at plan time if it is not there exactly once."""
    if template.count(placeholder) != 1:
        raise ValueError(f"the placeholder {placeholder} must occur exactly once")
    before, after = template.split(placeholder)
    return F.concat(F.lit(before), value, F.lit(after))


def messages(prompt: Column, images: Column) -> Column:
    """Chat content: image parts before the text part."""
    image = F.transform(images, lambda u: F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), u.alias("url")))
    return F.concat(image, F.array(F.struct(F.lit("text").alias("type"), prompt.alias("text"), F.lit(None).cast("string").alias("url"))))


def insert_before(prompt: Column, marker: str, context: Column) -> Column:
    """``context`` and a blank line before the first ``marker``; at the end where there is none."""
    at = F.instr(prompt, marker)
    return F.when(at > 0, F.concat(F.substring(prompt, F.lit(1), at - 1), context, F.lit("\n\n"), F.substring(prompt, at, F.length(prompt)))).otherwise(F.concat(prompt, F.lit("\n\n"), context))


TRUE_WORDS, FALSE_WORDS = ("true", "yes", "1"), ("false", "no", "0")


def as_bool(*candidates: Column, default: bool = False) -> Column:
    """The first candidate that reads as a boolean."""
    read = [F.when(F.lower(F.trim(c)).isin(*TRUE_WORDS), True).when(F.lower(F.trim(c)).isin(*FALSE_WORDS), False) for c in candidates]
    return F.coalesce(*read, F.lit(default))


def as_share(*candidates: Column, default: float = 0.0) -> Column:
    """The first candidate that reads as a number in [0, 1]; percentages and values in (1, 100] are divided by 100."""
    out = []
    for c in candidates:
        x = F.regexp_replace(F.trim(c), "%$", "").try_cast("double")
        out.append(F.when((x >= 0) & (x <= 1), x).when((x > 1) & (x <= 100), x / 100))
    return F.coalesce(*out, F.lit(default))


def renamed(record: Column, aliases: Mapping[str, Sequence[str]]) -> list[Column]:
    """Canonical fields of a map column, each from the first of its aliases that is filled."""
    return [F.coalesce(*(_filled(record[a]) for a in names), F.lit("")).alias(field) for field, names in aliases.items()]


def endpoint(base_url: str, suffix: str) -> str:
    """The service's URL with the suffix exactly once; a driver-side setting."""
    base = base_url.strip().rstrip("/")
    return base if base.endswith(suffix) else f"{base}/{suffix.lstrip('/')}"


def needs_localising(url: Column, hosts: Sequence[str] = ("user-images.githubusercontent.com", "private-user-images.githubusercontent.com", "github.com")) -> Column:
    """Remote images that a model service may not fetch by itself: on the hosts, or without an image suffix."""
    host = F.lower(F.regexp_extract(url, "(?i)^https?://([^/?#:]+)", 1))
    suffix = F.lower(F.regexp_extract(url, r"(?i)^[^?#]*\.(png|jpe?g|gif|webp)(?:[?#]|$)", 1))
    return url.rlike("(?i)^https?://") & (host.isin(*hosts) | (suffix == ""))


def without_images(content: Column) -> Column:
    return F.filter(content, lambda p: ~p["type"].isin("image_url", "image", "input_image"))


def assistant_content(response: Column) -> Column:
    """The text of a chat response (JSON): a string, or the texts of a list of parts."""
    whole = F.get_json_object(response, "$.choices[0].message.content")
    parts = F.from_json(whole, "array<struct<type:string,text:string>>")
    listed = F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda x: x.isNotNull()), "")
    return F.when(whole.startswith("["), F.coalesce(F.nullif(listed, F.lit("")), whole)).otherwise(whole)


def data_url(content: Column, mime: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.base64(content))


def strip_fence(text: Column) -> Column:
    """The text inside one outer code fence of three lines or more, else the text, trimmed."""
    t = F.trim(F.regexp_replace(text, r"\A\s+|\s+\z", ""))
    return F.when(t.rlike(r"(?s)\A```[^\n]*\n.*\n```\z"), F.regexp_extract(t, r"(?s)\A```[^\n]*\n(.*)\n```\z", 1)).otherwise(t)


def truth(value: Column) -> Column:
    """Whether a variant is anything but null, false, zero, or an empty string, array or object; null counts as false."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    return F.coalesce(
        F.when(F.is_variant_null(value), False).when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean")).when(kind == "STRING", F.try_variant_get(value, "$", "string") != "")
        .when(kind.startswith("ARRAY"), F.size(F.try_variant_get(value, "$", "array<variant>")) > 0).when(kind.startswith("OBJECT"), kind != "OBJECT<>").otherwise(number != 0), F.lit(False),
    )


def bug_record(answer: Column) -> Column:
    """struct of a detector's JSON answer; null for no JSON object.

    bug_found is the truth of the field, so that the string "no" is true; the
    others are variants, as given: a field that is there counts even if it is
    null, one that is missing has its default. bug_description falls back to
    summary, evidence_steps to step_analysis.
    """
    whole = F.try_parse_json(answer)
    given = lambda name: F.try_variant_get(whole, f"$.{name}", "variant")
    lit = lambda text: F.parse_json(F.lit(text))
    record = F.struct(
        truth(given("bug_found")).alias("bug_found"), F.coalesce(given("bug_type"), lit('"unknown"')).alias("bug_type"), given("bug_page_step").alias("bug_page_step"),
        F.coalesce(given("bug_description"), given("summary"), lit('""')).alias("bug_description"), given("confidence").alias("confidence"),
        F.coalesce(given("evidence_steps"), given("step_analysis"), lit("[]")).alias("evidence_steps"), F.coalesce(given("exploration_feedback"), lit("[]")).alias("exploration_feedback"),
    )
    return F.when(F.schema_of_variant(whole).startswith("OBJECT"), record)


def judgment(answer: Column, known: Column) -> Column:
    """struct(decision, family, error) of a judge's tagged answer; the tag says which fields must be there.

    NO_MATCH names no family, EQUIVALENT and VARIANT one of ``known``, VARIANT
    also a delta. error is null where all of that holds.
    """
    decision, family, delta = (F.get_json_object(answer, f"$.{n}") for n in ("decision", "family", "delta"))
    listed = F.array_contains(known, family)
    error = (
        F.when(F.get_json_object(answer, "$").isNull(), "no JSON")
        .when(decision.isNull() | ~decision.isin("NO_MATCH", "EQUIVALENT", "VARIANT"), "unknown decision")
        .when((decision == "NO_MATCH") & family.isNotNull(), "a family without a match")
        .when((decision != "NO_MATCH") & (family.isNull() | ~listed), "unknown family")
        .when((decision == "VARIANT") & F.coalesce(_filled(delta), F.lit("")).eqNullSafe(""), "no delta")
    )
    return F.struct(decision.alias("decision"), family.alias("family"), error.alias("error"))
