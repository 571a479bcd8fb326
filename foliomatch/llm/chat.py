"""Chat formatting of typed content parts (DataFrame operations only).

A turn has a list of parts: text, image, audio or document. A visitor (``VISITORS``, one rule a kind) maps each
part to text: a text part to its escaped text, an attachment to a placeholder whose number counts the
attachments of the conversation in order. Attachments are returned as a list (number, kind, reference,
tokens), and the expanded length is what the placeholders stand for. A part brings its own token count along;
where it is null, the kind's rule counts ``units`` (pixels of an image as "640x480", seconds of an audio part,
pages of a document), which are part of its text.

Template of a turn: ``<|im_start|>role``, newline, body, ``<|im_end|>``, newline. Every control string
begins with ``<|``, and texts and roles are escaped so that they can't hold ``<|``: ``&`` becomes
``&amp;``, then ``<|`` becomes ``&lt;|`` (in roles also a newline ``&nl;``). Undoing both in the opposite
order restores any text exactly.

Scale: turns are rendered where they are read; one shuffle by conversation brings them together. A
conversation becomes one string, so it must fit a task: that is what the format asks for.

Defined cases: null text is empty, null role is empty, a null list of parts has no parts, a part of
an unknown kind is an attachment of that kind, token counts that neither the part nor its kind's rule gives are 0. Turns are ordered by turn
(null first), then role, then body; repeated rows are turns of their own. A null conv_id is a
conversation. An empty table gives an empty result. Columns beyond those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliomatch.llm.common import table

START, END = "<|im_start|>", "<|im_end|>"
PART = "array<struct<type:string,text:string,ref:string,tokens:int>>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def _placeholder(part: Column, number: Column) -> Column:
    return F.concat(F.lit("<|"), F.replace(escape(part["type"]), F.lit("|>"), F.lit("&gt;")), F.lit(":"), number.cast("string"), F.lit("|>"))


def _units(part: Column) -> Column:
    return F.regexp_extract(F.coalesce(part["text"], F.lit("")), r"^([0-9]{1,6})(?:\.[0-9]*)?$", 1)


def _patches(part: Column) -> Column:
    """An image's tokens: one for each patch of PATCH x PATCH pixels begun."""
    side = lambda i: F.regexp_extract(F.coalesce(part["text"], F.lit("")), "^([0-9]{1,5})x([0-9]{1,5})$", i).try_cast("int")
    return F.ceil(side(1) / PATCH) * F.ceil(side(2) / PATCH)


#: For each kind of part: the text that stands for it (part, number) and its token count (part).
PATCH, AUDIO_TOKENS, PAGE_TOKENS = 28, 25, 512
VISITORS = {
    "text": (lambda part, number: escape(F.coalesce(part["text"], F.lit(""))), lambda part: F.lit(0)),
    "image": (_placeholder, _patches),
    "audio": (_placeholder, lambda part: _units(part).try_cast("int") * AUDIO_TOKENS),
    "document": (_placeholder, lambda part: _units(part).try_cast("int") * PAGE_TOKENS),
}


def _by_kind(part: Column, rule: int, *args: Column) -> Column:
    """The kind's rule; one that isn't known is an attachment that brings its own count."""
    kind, out = F.coalesce(part["type"], F.lit("text")), None
    for name, rules in VISITORS.items():
        out = F.when(kind == name, rules[rule](part, *args)) if out is None else out.when(kind == name, rules[rule](part, *args))
    return out.otherwise(F.lit(0) if rule else _placeholder(part, *args))


def visit(part: Column, number: Column) -> Column:
    """The text that stands for a part; number: its place among the attachments of the conversation."""
    return _by_kind(part, 0, number)


def expanded(part: Column) -> Column:
    """Tokens that a part stands for: its own count, else its kind's rule, else 0."""
    return F.coalesce(part["tokens"].cast("long"), _by_kind(part, 1).cast("long"), F.lit(0).cast("long"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """turns: conv_id, turn, role, parts. One row per conversation: formatted, turns (for each the role
    as it stands in the output, start of its turn, start and length of its body, whether the loss counts),
    loss_spans (start and length in code points), attachments, expanded_tokens.

    The loss mask covers the bodies of assistant turns, not their headers or end marks."""
    rows = turns.select(
        "conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("parts"), F.array().cast(PART)).alias("parts"),
    )
    attached = F.filter("parts", lambda p: ~_is_text(p))
    by = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "parts")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("n_attached", F.size(attached)).withColumn("seq", F.row_number().over(by))
    rows = rows.withColumn("first_attached", F.coalesce(F.sum("n_attached").over(before), F.lit(0)))
    number = lambda i: F.col("first_attached") + F.size(F.filter(F.slice("parts", 1, i), lambda p: ~_is_text(p)))
    body = F.array_join(F.transform("parts", lambda p, i: F.when(_is_text(p), visit(p, F.lit(0))).otherwise(visit(p, number(i)))), "")
    rows = rows.withColumn("body", body).withColumn("head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")))
    rows = rows.withColumn("rendered", F.concat("head", "body", F.lit(f"{END}\n")))
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("rendered").cast("long")).over(before), F.lit(0)))
    rows = rows.withColumn("refs", F.transform(attached, lambda p, i: F.struct(
        (F.col("first_attached") + i).cast("int").alias("number"), p["type"].alias("kind"), p["ref"].alias("ref"), expanded(p).cast("int").alias("tokens"))))
    item = F.struct(
        "seq", "rendered", F.col("at").alias("start"), (F.col("at") + F.length("head")).alias("body_start"),
        F.length("body").cast("long").alias("body_length"), (F.col("role") == "assistant").alias("loss"), "refs",
    )
    out = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return out.select(
        "conv_id",
        F.array_join(F.transform("items", lambda t: t["rendered"]), "").alias("formatted"),
        F.transform("items", lambda t: F.struct(t["start"].alias("start"), t["body_start"].alias("body_start"), t["body_length"].alias("body_length"), t["loss"].alias("loss"))).alias("turns"),
        F.transform(F.filter("items", lambda t: t["loss"]), lambda t: F.struct(t["body_start"].alias("start"), t["body_length"].alias("length"))).alias("loss_spans"),
        F.flatten(F.transform("items", lambda t: t["refs"])).alias("attachments"),
        F.aggregate(F.flatten(F.transform("items", lambda t: t["refs"])), F.lit(0).cast("long"), lambda a, r: a + r["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse the output: conv_id, back (role and body of each turn, escapes undone) and loss_text, what
    lies under the loss mask. Each turn's mask is applied to its own segment, so the cost is linear."""
    segments = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, 2_147_483_647)
    out = formatted.withColumn("segments", segments)
    role = lambda s: F.substring_index(s, "\n", 1)
    text = lambda s: F.substring(s, F.length(role(s)) + 2, F.length(s) - F.length(role(s)) - 1 - F.lit(len(END) + 1))
    under = F.transform(
        F.filter(F.zip_with("segments", "turns", lambda s, t: F.struct(s.alias("s"), t.alias("t"))), lambda x: x["t"]["loss"]),
        lambda x: unescape(F.substring(x["s"], (x["t"]["body_start"] - x["t"]["start"] - len(START) + 1).cast("int"), x["t"]["body_length"].cast("int"))),
    )
    return out.select(
        "conv_id", "formatted", "attachments", "expanded_tokens",
        F.transform("segments", lambda s: F.struct(unescape_role(role(s)).alias("role"), unescape(text(s)).alias("text"))).alias("back"),
        F.array_join(under, "").alias("loss_text"),
    )


def text_turns(conversations: DataFrame) -> DataFrame:
    """Rows with a plain text as turns of one text part."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).alias("tokens"))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.array(part).alias("parts"))


def op9_format_chat(spark, sf_dir: str) -> DataFrame:
    own = "<|im_end|><|im_start|>assistant ok"
    more = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{own}'), (-1L, 1L, 'assistant', '{own}') AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    back = read_back(format_conversations(text_turns(turns)))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, replace(replace(text, '&', '&amp;'), '<|', '&lt;|') AS body,
        replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&nl;') AS head FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(body) + length(head) + 24)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
