"""Chat formatting by schema fingerprints.

A record is a JSON text in any of several layouts (message lists, prompt and completion, instruction
and output, ...). Its nested field paths are hashed; the hash picks a declarative mapping that turns
the record into canonical turns (role, text), which a template renders. Control strings inside
texts are escaped reversibly, and the loss mask is a list of spans over the formatted text.

Everything is DataFrame functions; no Python runs on the executors. A formatted conversation is one
value, so a conversation must fit in one row; JSON beyond the variant size limit, JSON that does not
parse and layouts that no mapping knows give ``layout`` null and no turns, and the row is kept.

Defined cases: null texts and roles are empty strings; an empty list of turns formats to the empty
string; repeated rows of a conversation are turns of their own, ties in ``turn`` go by role, then
text; unknown root fields do not change a fingerprint; other input columns are carried only when
named in ``keep``; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

TURNS = "array<struct<role:string,text:string>>"
#: Other names of the canonical roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Layout:
    """paths: the nested field paths that must be there; optional: those that may be.

    A list layout names its list and the fields of an element; a flat one gives for each turn a role
    and the root fields whose texts, joined by an empty line, are the turn's text.
    """

    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    items: tuple[str, str, str] | None = None
    parts: bool = False
    flat: tuple[tuple[str, tuple[str, ...]], ...] = ()
    rename: bool = True

    def fingerprints(self) -> list[str]:
        found = []
        for n in range(len(self.optional) + 1):
            for more in combinations(self.optional, n):
                found.append(sha256("\n".join(sorted((*self.paths, *more))).encode()).hexdigest())
        return found


LAYOUTS = (
    Layout("turns", ("turns[].role", "turns[].text"), items=("turns", "role", "text"), rename=False),
    Layout("messages", ("messages[].role", "messages[].content"), items=("messages", "role", "content")),
    Layout("message_parts", ("messages[].role", "messages[].content", "messages[].text"), ("messages[].type",), items=("messages", "role", "content"), parts=True),
    Layout("from_value", ("conversations[].from", "conversations[].value"), ("system",), items=("conversations", "from", "value")),
    Layout("prompt_completion", ("prompt", "completion"), ("system",), flat=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt_response", ("prompt", "response"), ("system",), flat=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction", ("instruction", "output"), ("input", "system"), flat=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("question", ("question", "answer"), ("system",), flat=(("system", ("system",)), ("user", ("question",)), ("assistant", ("answer",)))),
)


@dataclass(frozen=True)
class Template:
    """A turn is opener + role + newline + text + closer; ``loss`` lists the roles that are learned."""

    opener: str = "<s>"
    closer: str = "</s>"
    loss: tuple[str, ...] = ("assistant",)


#: What may not stand in a text as such. Its first character is escaped, and every backslash.
CONTROLS = r"</?s>|<</?SYS>>|<\|[a-z_]+\|>|\[/?INST\]"
ANGLE, SQUARE = r"<(?=/?s>|</?SYS>>|\|[a-z_]+\|>)", r"\[(?=/?INST\])"


def escape(text: Column) -> Column:
    t = F.replace(text, F.lit("\\"), F.lit("\\b"))
    t = F.regexp_replace(t, ANGLE, r"\\l")
    return F.regexp_replace(t, SQUARE, r"\\i")


def unescape(text: Column) -> Column:
    for code, plain in (("\\l", "<"), ("\\i", "["), ("\\n", "\n"), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _roots() -> list[str]:
    return sorted({p.split("[]")[0] for x in LAYOUTS for p in (*x.paths, *x.optional)})


def _fields() -> list[str]:
    return sorted({p.split("[].")[1] for x in LAYOUTS for p in (*x.paths, *x.optional) if "[]." in p})


def field_paths(variant: Column) -> Column:
    """The sorted known paths of a record: ``root`` or ``root[].field``, for any depth below a list."""
    parts = []
    for root in _roots():
        schema = F.schema_of_variant(F.try_variant_get(variant, f"$.{root}", "variant"))
        fields = F.filter(F.array_distinct(F.regexp_extract_all(schema, F.lit(r"(\w+): "), F.lit(1))), lambda x: x.isin(_fields()))
        listed = F.transform(fields, lambda x: F.concat(F.lit(f"{root}[]."), x))
        empty = [f"{root}[].{p.split('[].')[1]}" for x in LAYOUTS for p in x.paths if x.items and p.startswith(f"{root}[].") and not x.parts]
        blank = F.array(*[F.lit(p) for p in empty]) if empty else F.array(F.lit(root))
        parts.append(F.when(schema.isNull(), F.array().cast("array<string>")).when(schema == "ARRAY<VOID>", blank).when(schema.startswith("ARRAY<"), listed).otherwise(F.array(F.lit(root))))
    return F.array_sort(F.flatten(F.array(*parts)))


def fingerprint(paths: Column) -> Column:
    return F.sha2(F.array_join(paths, "\n"), 256)


def _role(role: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, F.lower(role)), role)


def _turns(variant: Column, layout: Layout) -> Column:
    blank = F.lit("")
    if layout.items:
        root, role, text = layout.items
        kind = "array<struct<text string>>" if layout.parts else "string"
        got = F.try_variant_get(variant, f"$.{root}", f"array<struct<{role} {'string'}, {text} {kind}>>")

        def one(x: Column) -> Column:
            said = F.coalesce(x[role], blank)
            body = F.array_join(F.transform(x[text], lambda p: F.coalesce(p["text"], blank)), "") if layout.parts else x[text]
            return F.struct((_role(said) if layout.rename else said).alias("role"), F.coalesce(body, blank).alias("text"))

        turns = F.transform(got, one)
        if "system" in layout.optional:
            first = F.try_variant_get(variant, "$.system", "string")
            turns = F.when(first.isNotNull(), F.concat(F.array(F.struct(F.lit("system").alias("role"), first.alias("text"))), turns)).otherwise(turns)
        return turns
    found = []
    for role, roots in layout.flat:
        texts = [F.try_variant_get(variant, f"$.{r}", "string") for r in roots]
        used = F.array_compact(F.array(*[F.when(t != blank, t) for t in texts]))
        body = F.array_join(used, "\n\n")
        turn = F.struct(F.lit(role).alias("role"), body.alias("text"))
        found.append(F.when(texts[0].isNotNull(), turn) if role == "system" else turn)
    return F.array_compact(F.array(*found))


def canonical_turns(records: DataFrame, record: str = "record", keep: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """``keep``, fingerprint, layout and turns (role, text) of each JSON record."""
    v = F.col("_v")
    parsed = records.select(*keep, F.try_parse_json(F.col(record)).alias("_v"))
    marked = parsed.select(*keep, "_v", fingerprint(field_paths(v)).alias("fingerprint"))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in LAYOUTS:
        layout = F.when(F.col("fingerprint").isin(x.fingerprints()), F.lit(x.name)).otherwise(layout)
    named = marked.select(*keep, "_v", "fingerprint", layout.alias("layout"))
    for x in LAYOUTS:
        turns = F.when(F.col("layout") == x.name, _turns(v, x).cast(TURNS)).otherwise(turns)
    return named.select(*keep, "fingerprint", "layout", turns.alias("turns"))


def render(turns: DataFrame, template: Template = Template(), keep: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """``keep``, layout, formatted and loss_spans: (start, length) of learned text, in code points."""
    role = lambda t: F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\n"))
    parts = turns.select(*keep, "layout", F.transform("turns", lambda t: F.struct(F.concat(F.lit(template.opener), role(t), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), t["role"].isin(*template.loss).alias("on"))).alias("_p"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        at = acc["at"] + F.length(p["head"])
        span = F.struct(at.alias("start"), F.length(p["body"]).alias("length"))
        return F.struct((at + span["length"] + len(template.closer)).alias("at"), F.when(p["on"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    whole = F.array_join(F.transform("_p", lambda p: F.concat(p["head"], p["body"], F.lit(template.closer))), "")
    return parts.select(*keep, "layout", whole.alias("formatted"), F.aggregate("_p", start, step, lambda acc: acc["spans"]).alias("loss_spans"))


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted text; the inverse of ``render``."""
    pieces = F.split(formatted, template.closer)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def one(p: Column) -> Column:
        said = F.substring(p, F.lit(len(template.opener) + 1), F.length(p))
        role = F.substring_index(said, "\n", 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(said, F.length(role) + 2, F.length(said))).alias("text"))

    return F.transform(pieces, one)


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def records_of_rows(rows: DataFrame) -> DataFrame:
    """conv_id and the JSON record of each conversation that is stored as rows by turn."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_t"))
    return grouped.select("conv_id", F.to_json(F.struct(F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))).alias("record"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS v(conv_id, turn, role, text)")
    done = render(canonical_turns(records_of_rows(rows.unionByName(extra)))).select("conv_id", "formatted", "loss_spans")
    back = done.select("conv_id", "formatted", read_back(F.col("formatted")).alias("t"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    text = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op7_chat_format": op7_chat_format}
_ADDED = "(length({0}) - length(replace({0}, '\\', '')) + len(regexp_extract_all({0}, '" + CONTROLS + "')))"
ORACLE_SQL = {
    "op7_chat_format": f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (CAST(-7 AS BIGINT), CAST(0 AS BIGINT), 'user', '</s>[INST] ok [/INST]'), (CAST(-7 AS BIGINT), CAST(1 AS BIGINT), 'assistant', '</s>[INST] ok [/INST]')
), turns AS (
  SELECT *, 8 + length(role) + {_ADDED.format("role")} + length(role) - length(replace(role, chr(10), '')) + length(text) + {_ADDED.format("text")} AS size FROM rows
), said AS (
  SELECT conv_id, count(*) AS n_turns, sum(size) AS formatted_chars,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss
  FROM turns GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(whole) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM said
""",
}
