"""Content of chat messages and requests: text of parts, header and kind predicates, scripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalars

#: Headers that belong to one connection, and those that name a conversation.
HOP = ("connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailers", "transfer-encoding", "upgrade", "host", "content-length", "accept-encoding")
CREDENTIALS = ("authorization", "x-api-key")
#: Request keys and item types that hold no text of the user's.
NOT_TEXT = ("tools", "functions", "tool_choice", "response_format", "metadata", "text")
NOT_ITEMS = ("function_call", "reasoning")
NAME_KINDS = ("PERSON", "ADDRESS", "ORG", "LOCATION")
MASKING = ("trusted_masked", "public")
#: Devanagari and Bengali letters and signs, without the two full stops; with the joiners.
INDIC = "\\u0900-\\u0963\\u0966-\\u09FF"


def text_of(content: Column) -> Column:
    """JSON content as text: a string itself; of a list, the text of each part (or the part, if it is a string, or its own content) by lines; null is empty; other JSON as it is written."""
    parts = F.from_json(content, "array<string>")
    one = lambda p: F.coalesce(F.get_json_object(p, "$.text"), F.when(~F.trim(p).rlike(r"^[\[{]"), p), F.get_json_object(p, "$.content"))
    listed = F.array_join(F.filter(F.transform(parts, one), lambda t: t.isNotNull()), "\n")
    value = F.trim(content)
    plain = F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string")["v"]
    return F.when(content.isNull() | (value == "null"), "").when(value.startswith("["), listed).when(value.startswith('"'), plain).otherwise(content)


def image_url(source: Column) -> Column:
    """The url of an image source (type, media_type, data, url): a data: url for base64, null for other types."""
    inline = F.concat(F.lit("data:"), F.coalesce(source["media_type"], F.lit("image/png")), F.lit(";base64,"), F.coalesce(source["data"], F.lit("")))
    return F.when(source["type"] == "base64", inline).when(source["type"] == "url", F.coalesce(source["url"], F.lit("")))


def is_user_text(key: Column, role: Column, item_type: Column) -> Column:
    """Whether a string under a top-level request key, in an item of that role and type, is text that a tagger should see."""
    item = key.isin("messages", "input") & (F.coalesce(role == "assistant", F.lit(False)) | F.coalesce(item_type.isin(*NOT_ITEMS), F.lit(False)))
    return ~key.isin(*NOT_TEXT) & ~item


def forwarded(headers: Column, own_prefix: str, conversation: tuple[str, ...] = (), translating: bool = False, masked: bool = False, bearer: bool = False) -> Column:
    """The headers (map, lower-case names) that may go on to a target."""
    def keep(k: Column) -> Column:
        gone = k.isin(*HOP) | k.startswith(own_prefix)
        if masked and conversation:
            gone = gone | k.isin(*conversation)
        if translating:
            gone = gone | k.startswith("anthropic-") | k.isin(*CREDENTIALS, "content-type")
        if bearer:
            gone = gone | k.isin(*CREDENTIALS)
        return ~gone

    return F.map_filter(headers, lambda k, _: keep(k))


def request_id(prefix: str) -> Column:
    """prefix and 96 random bits in hexadecimal; differs on every run."""
    return F.concat(F.lit(prefix), F.left(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit(24)))


def is_stream(body: Column) -> Column:
    return F.coalesce(F.get_json_object(body, "$.stream") == "true", F.lit(False))


def mask_header(tier: Column, masked: Column) -> Column:
    return F.concat(F.lit("tier="), F.coalesce(tier, F.lit("-")), F.lit("; masked="), F.coalesce(masked, F.lit(0)).cast("string"))


def masks(tier: Column) -> Column:
    return tier.isin(*MASKING)


def name_like(kind: Column) -> Column:
    """Kinds that may be part of a link and are left alone there."""
    return kind.isin(*NAME_KINDS)


def has_indic(text: Column) -> Column:
    return text.rlike("[\\u0900-\\u09FF]")


def is_bengali(text: Column) -> Column:
    return text.rlike("[\\u0980-\\u09FF]")


def indic_runs(text: Column) -> Column:
    """Stretches of Indic letters, blanks and full stops that hold a letter, trimmed, by lines."""
    runs = F.regexp_extract_all(text, F.lit(f"[{INDIC}\\u200C\\u200D .]+"), F.lit(0))
    return F.array_join(F.transform(F.filter(runs, lambda r: r.rlike(f"[{INDIC}]")), lambda r: F.trim(r)), "\n")


def words_of(text: Column) -> Column:
    """The different lower-case words of a text."""
    return F.array_distinct(F.filter(F.split(scalars.lower_letters(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def has_phrase(text: Column, phrase: str) -> Column:
    """Whether text holds phrase (lower case) between word edges; ASCII letters, digits and _ are word characters, as are other letters."""
    quoted = "".join(c if c.isalnum() else "\\" + c for c in phrase)
    edge = r"[\p{L}\p{N}_]"
    return F.lower(text).rlike(f"(?<!{edge}){quoted}(?!{edge})")
