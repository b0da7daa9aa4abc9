"""Text of chat requests and responses, and routing by decision."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweir.functions.arrays import let
from textweir.functions.fixed import BODY_FIELDS, SKIPPED_METHODS
from textweir.functions.names import fresh

from . import pii
from .chain import ScanConfig, scan
from .injection import utf16_length

#: Messages whose content is a list of blocks; plain strings are one text block.
MESSAGES = "array<struct<role:string,content:array<struct<type:string,text:string>>>>"


def string_field(body: Column, path: str) -> Column:
    """A field of parsed JSON if it is a string; numbers and objects are not."""
    value = F.try_variant_get(body, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(body, path, "string"))


def body_text(body: Column) -> Column:
    """Text of a JSON request body: the first of the usual fields that holds a string, even an
    empty one, else the string contents of user messages, one to a line; null without (X1, X2)."""
    parsed = F.try_parse_json(body)
    direct = F.coalesce(*[string_field(parsed, f"$.{name}") for name in BODY_FIELDS])
    listed = F.try_variant_get(parsed, "$.messages", "array<variant>")
    users = F.filter(listed, lambda m: (string_field(m, "$.role") == "user") & string_field(m, "$.content").isNotNull())
    texts = F.transform(users, lambda m: string_field(m, "$.content"))
    return F.coalesce(direct, F.when(F.size(texts) > 0, F.array_join(texts, "\n")))


def user_text(messages: Column, keep_empty: bool = False, no_role_is_user: bool = False) -> Column:
    """Text blocks of user messages, one to a line."""
    role = lambda m: F.coalesce(m["role"], F.lit("user")) if no_role_is_user else m["role"]
    said = F.flatten(F.transform(F.filter(messages, lambda m: role(m) == "user"), lambda m: m["content"]))
    kept = F.filter(said, lambda b: (b["type"] == "text") & (b["text"].isNotNull() if keep_empty else F.length(b["text"]) > 0))
    return F.array_join(F.transform(kept, lambda b: b["text"]), "\n")


def system_text(messages: Column) -> Column:
    """Text blocks of system messages, one to a line."""
    said = F.flatten(F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: m["content"]))
    kept = F.filter(said, lambda b: (b["type"] == "text") & (F.length(b["text"]) > 0))
    return F.array_join(F.transform(kept, lambda b: b["text"]), "\n")


def scan_system(conversations: DataFrame, config: ScanConfig | None = None, messages: str = "messages") -> DataFrame:
    """Scans system prompts by themselves, for injection only: they are the operator's own and may
    hold personal data (X8). Conversations without one give no row."""
    (text,) = fresh(conversations, "_system")
    asked = conversations.withColumn(text, system_text(F.col(messages))).where(F.length(text) > 0)
    return scan(asked, text, replace(config or ScanConfig(), pii=False, tools=None)).drop(text)


def normalised(request: Column) -> Column:
    """A JSON request as messages: a string is one user message, an array is a list of messages or
    strings, an object one message; contents are strings, or lists of blocks or strings (X6). Null
    where nothing fits."""
    parsed = F.try_parse_json(request)
    kind = lambda v: F.substring(F.schema_of_variant(v), 1, 5)

    def as_block(v: Column) -> Column:
        plain = F.struct(F.lit("text").alias("type"), F.try_variant_get(v, "$", "string").alias("text"))
        part = F.coalesce(string_field(v, "$.type"), F.when(string_field(v, "$.text").isNotNull(), "text"))
        return F.when(F.schema_of_variant(v) == "STRING", plain).otherwise(F.struct(part.alias("type"), string_field(v, "$.text").alias("text")))

    def content(v: Column) -> Column:
        many = lambda path: F.transform(F.try_variant_get(v, path, "array<variant>"), as_block)
        one = lambda path: F.when(string_field(v, path).isNotNull(), F.array(F.struct(F.lit("text").alias("type"), string_field(v, path).alias("text"))))
        return F.coalesce(one("$.content"), many("$.content"), one("$.text"), many("$.parts"), F.array().cast("array<struct<type:string,text:string>>"))

    def message(v: Column) -> Column:
        plain = F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("text").alias("type"), F.try_variant_get(v, "$", "string").alias("text"))).alias("content"))
        role = F.coalesce(string_field(v, "$.role"), F.lit("user"))
        return F.when(F.schema_of_variant(v) == "STRING", plain).otherwise(F.struct(role.alias("role"), content(v).alias("content")))

    return F.when(kind(parsed) == "ARRAY", F.transform(F.try_variant_get(parsed, "$", "array<variant>"), message)).when(
        kind(parsed).isin("STRIN", "OBJEC"), F.array(message(parsed))
    )


def messages_of(text: Column) -> Column:
    """A plain request as one user message."""
    return F.array(F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content")))


def response_text(content: Column) -> Column:
    """Text blocks of a response, one to a line."""
    return F.array_join(F.transform(F.filter(content, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")


def tool_names(declared: Column) -> Column:
    """Names of declared functions as tool calls."""
    return F.transform(declared, lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("server_id")))


def declared_tools(request: Column) -> Column:
    """Names of the functions that a JSON request declares, as tool calls: tools by name, by function,
    or in nested lists of function declarations (X9)."""
    tools = F.try_variant_get(F.try_parse_json(request), "$.tools", "array<variant>")

    def names(v: Column) -> Column:
        nested = F.transform(F.try_variant_get(v, "$.functionDeclarations", "array<variant>"), lambda f: string_field(f, "$.name"))
        own = F.array(F.coalesce(string_field(v, "$.name"), string_field(v, "$.function.name")))
        return F.array_compact(F.coalesce(nested, own))

    return tool_names(F.coalesce(F.flatten(F.transform(tools, names)), F.array().cast("array<string>")))


def is_user_text(message: Column, block: Column) -> Column:
    return F.coalesce((message["role"] == "user") & (block["type"] == "text") & (F.length(block["text"]) > 0), F.lit(False))


def with_texts(messages: Column, text: Callable[[Column, Column], Column]) -> Column:
    """Messages whose text blocks of user messages have the text that `text` makes of the message and
    the place of the block in it; all else stays."""

    def message(m: Column) -> Column:
        block = lambda b, i: F.struct(b["type"].alias("type"), F.when(is_user_text(m, b), text(m, i)).otherwise(b["text"]).alias("text"))
        return F.struct(m["role"].alias("role"), F.transform(m["content"], block).alias("content"))

    return F.transform(messages, message)


def masked_messages(messages: Column, mask: Callable[[Column], Column] | None = None) -> Column:
    """Messages with each text block of a user message masked by itself (X10), by default as the
    personal data scanner masks: no text moves from one block to another, whatever its mask's length."""
    own = mask or (lambda text: pii.sanitize(text, pii.detect(text)))
    return with_texts(messages, lambda m, i: own(F.get(m["content"], i)["text"]))


def utf16_cut(text: Column, start: Column, length: Column) -> Column:
    """`length` UTF-16 units of a text from `start` (from 0); half of a pair is U+FFFD."""
    part = F.substring(F.encode(text, "UTF-16BE"), start * 2 + 1, length * 2)
    half = F.unhex(F.lit("FFFD"))
    mended = lambda p: F.when(F.hex(F.substring(p, 1, 2)).between("DC00", "DFFF"), F.concat(half, F.substring(p, F.lit(3), F.length(p)))).otherwise(p)
    whole = lambda p: F.when(F.hex(F.substring(p, -2, 2)).between("D800", "DBFF"), F.concat(F.substring(p, F.lit(1), F.length(p) - 2), half)).otherwise(p)
    return F.when(F.length(part) > 0, F.decode(let(let(part, mended), whole), "UTF-16BE")).otherwise("")


def rewrite_parts(messages: Column, sanitized: Column) -> Column:
    """Messages with slices of a joint sanitized text, as the screened clients cut it: each user
    message from its start, each text block as many UTF-16 units as it had, one between (X10).
    Messages so get each other's text; masked_messages() keeps them apart."""
    size = lambda m, b: F.when(is_user_text(m, b), utf16_length(b["text"]) + 1).otherwise(0)

    def text(m: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(F.transform(m["content"], lambda b: size(m, b)), F.lit(1), i), F.lit(0), lambda a, x: a + x.cast("int"))
        return utf16_cut(sanitized, before, utf16_length(F.get(m["content"], i)["text"]).cast("int"))

    return with_texts(messages, text)


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, messages) from one row a turn, in order of turns."""
    message = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.array(F.struct(F.lit("text").alias("type"), F.col(text).alias("text"))).alias("content"))
    ordered = F.sort_array(F.collect_list(message))
    return turns.groupBy(F.col(conv).alias("conv_id")).agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def rewrite(turns: DataFrame, sanitized: DataFrame, keys: Sequence[str], text: str = "text", role: str = "role") -> DataFrame:
    """User turns with their own sanitized text; other turns as they are (X10, per message)."""
    (name,) = fresh(turns, "_new")
    new = sanitized.select(*keys, F.col("sanitized").alias(name))
    return turns.join(new, list(keys), "left").withColumn(text, F.when(F.col(role) == "user", F.coalesce(name, text)).otherwise(F.col(text))).drop(name)


def preflight_tokens(text: Column) -> Column:
    """Tokens assumed before a call (X11)."""
    return utf16_length(text) * 0.75


def screened(requests: DataFrame, method: str = "method", path: str = "path", skip_paths: Sequence[str] = ()) -> DataFrame:
    """Requests that are screened at all."""
    out = requests.where(~F.col(method).isin(*SKIPPED_METHODS))
    for prefix in skip_paths:
        out = out.where(~F.startswith(path, F.lit(prefix)))
    return out


def blocked_response(decision: Column, violations: Column) -> Column:
    """JSON body that answers a blocked request, with status 403."""
    shown = F.transform(violations, lambda v: F.struct(v["type"].alias("type"), v["message"].alias("message")))
    return F.to_json(F.struct(F.lit("Request blocked").alias("error"), decision.alias("decision"), shown.alias("violations")))


def routed(scanned: DataFrame) -> DataFrame:
    """Adds route (pass, warn or block), and status and response for blocked rows."""
    blocked = F.col("decision") == "block"
    return scanned.withColumns(
        {
            "route": F.when(blocked, "block").when(F.col("decision") == "warn", "warn").otherwise("pass"),
            "status": F.when(blocked, F.lit(403)),
            "response": F.when(blocked, blocked_response(F.col("decision"), F.col("violations"))),
        }
    )


def route(scanned: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(passed, warned, blocked), one scan of the input each; persist the input to share it."""
    each = routed(scanned)
    return each.where("route = 'pass'"), each.where("route = 'warn'"), each.where("route = 'block'")
