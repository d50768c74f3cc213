"""Chat formatting by schema fingerprints (operator 10).

A JSON record is parsed to VARIANT and the sorted paths of its nested fields (names and nesting, not scalar
types) are hashed. The hash selects a declarative mapping, which names the places of the turns; the
mapping is compiled to column expressions, so records never leave the JVM.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROLES = {"human": "user", "user": "user", "prompter": "user", "question": "user", "gpt": "assistant", "assistant": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant", "system": "system", "developer": "system", "tool": "tool", "function": "tool"}


@dataclass(frozen=True)
class Fields:
    """Turns in fields of their own: (role, paths joined by a blank line), in order; paths ending in ? may be absent."""

    name: str
    turns: tuple[tuple[str, tuple[str, ...]], ...]
    ignore: tuple[str, ...] = ()

    def shapes(self) -> list[dict]:
        paths = [p for _, ps in self.turns for p in ps] + [f"{p}?" for p in self.ignore]
        must, may = [p for p in paths if not p.endswith("?")], [p[:-1] for p in paths if p.endswith("?")]
        return [_nest({p: None for p in (*must, *some)}) for n in range(len(may) + 1) for some in itertools.combinations(may, n)]


@dataclass(frozen=True)
class Messages:
    """Turns in an array of objects; fields before it give turns too."""

    name: str
    array: str
    role: str
    content: str
    before: tuple[tuple[str, str], ...] = ()
    ignore: tuple[str, ...] = ()
    item_ignore: tuple[str, ...] = field(default=())

    def shapes(self) -> list[dict]:
        found = []
        optional = [*(p for _, p in self.before), *self.ignore]
        for n in range(len(optional) + 1):
            for some in itertools.combinations(optional, n):
                for m in range(len(self.item_ignore) + 1):
                    for more in itertools.combinations(self.item_ignore, m):
                        item = {self.role: None, self.content: None, **{x: None for x in more}}
                        found.append(_nest({**{p: None for p in some}, self.array: [item]}))
                found.append(_nest({**{p: None for p in some}, self.array: []}))
        return found


def _nest(flat: dict) -> dict:
    out: dict = {}
    for path, value in flat.items():
        *parents, leaf = path.split(".")
        at = out
        for p in parents:
            at = at.setdefault(p, {})
        at[leaf] = value
    return out


#: The layouts known by default. Users pass their own list to format_chat().
MAPPINGS: tuple[Fields | Messages, ...] = (
    Messages("messages", "messages", "role", "content", before=(("system", "system"),), ignore=("id",), item_ignore=("name",)),
    Messages("sharegpt", "conversations", "from", "value", before=(("system", "system"),), ignore=("id",)),
    Messages("dialog", "dialog", "speaker", "text", ignore=("id",)),
    Messages("rows", "turns", "role", "text", ignore=("id",)),
    Fields("instruction", (("system", ("system?",)), ("user", ("instruction", "input?")), ("assistant", ("output",))), ignore=("id",)),
    Fields("instruction_response", (("user", ("instruction", "context?")), ("assistant", ("response",))), ignore=("id", "category")),
    Fields("prompt_completion", (("system", ("system?",)), ("user", ("prompt",)), ("assistant", ("completion",))), ignore=("id",)),
    Fields("prompt_response", (("system", ("system_prompt?",)), ("user", ("prompt",)), ("assistant", ("response",))), ignore=("id",)),
    Fields("question_answer", (("system", ("system_prompt?",)), ("user", ("question",)), ("assistant", ("answer",))), ignore=("id",)),
    Fields("nested_qa", (("user", ("data.question",)), ("assistant", ("data.answer",))), ignore=("id",)),
    Fields("prompt_only", (("system", ("system?",)), ("user", ("prompt",))), ignore=("id",)),
)


def paths_text(shape: object) -> str:
    """The canonical text of a record's field paths: names sorted (by bytes), { and [ open objects and arrays, > closes them, scalars are blank."""
    if isinstance(shape, dict):
        return "{" + ",".join(k + paths_text(shape[k]) for k in sorted(shape, key=lambda k: k.encode())) + ">"
    if isinstance(shape, list):
        return "[" + (paths_text(shape[0]) if shape else "") + ">"
    return ""


def _paths_column(v: Column) -> Column:
    """paths_text() of a variant, from schema_of_variant(): drop the scalar types, keep names and nesting."""
    schema = F.schema_of_variant(v)
    schema = F.regexp_replace(schema, r"OBJECT<", "{")
    schema = F.regexp_replace(schema, r"ARRAY<", "[")
    schema = F.regexp_replace(schema, r"(: |\[)(?:STRING|BIGINT|BOOLEAN|DOUBLE|FLOAT|VOID|VARIANT|OBJECT|DATE|TIMESTAMP_NTZ|TIMESTAMP|BINARY|UUID|DECIMAL\(\d+,\d+\))", "$1")
    schema = F.regexp_replace(schema, ": ", "")
    return F.regexp_replace(schema, ", ", ",")


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a JSON text; NULL where it isn't JSON."""
    return F.xxhash64(_paths_column(F.try_parse_json(record)))


def _role(r: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    low = F.lower(F.trim(r))
    return F.coalesce(F.try_element_at(known, low), low)


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, "$" + "".join(f"['{p}']" for p in path.split(".")), "string")


_TURNS = "array<struct<role:string,text:string>>"


def _compile(m: Fields | Messages, v: Column) -> Column:
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    if isinstance(m, Fields):
        parts = []
        for role, paths in m.turns:
            pieces = F.filter(F.array(*(_get(v, p.rstrip("?")) for p in paths)), lambda x: x.isNotNull() & (x != ""))
            empty_ok = _get(v, paths[0].rstrip("?"))
            parts.append(turn(F.lit(role), F.when(F.size(pieces) > 0, F.array_join(pieces, "\n\n")).otherwise(empty_ok)))
        return F.filter(F.array(*parts), lambda t: t["text"].isNotNull()).cast(_TURNS)
    items = F.try_variant_get(v, f"$['{m.array}']", "array<variant>")
    body = F.transform(F.coalesce(items, F.array().cast("array<variant>")), lambda x: turn(_role(_get(x, m.role)), _get(x, m.content)))
    head = F.array(*(turn(F.lit(r), _get(v, p)) for r, p in m.before)) if m.before else F.array().cast(_TURNS)
    return F.concat(F.filter(head.cast(_TURNS), lambda t: t["text"].isNotNull()), body.cast(_TURNS))


def format_chat(records: DataFrame, id_col: str = "id", record_col: str = "record", mappings: tuple[Fields | Messages, ...] = MAPPINGS) -> DataFrame:
    """(id, turn, role, text, layout, fingerprint): the canonical turns of JSON records of any known layout.

    Turns are numbered from 0; roles are lower-cased and canonical (human -> user, gpt -> assistant; an unknown role stays as
    it is, NULL stays NULL). A turn with NULL content stays, with NULL text, in an array of messages; an absent or NULL
    field gives no turn. A record of an unknown layout, one that isn't JSON, NULL or one without turns gives a
    single row with NULL turn, role and text, and layout 'unknown', 'invalid', or the layout's name: none is lost.
    Objects of an array count as alike if their paths, merged, are known. Repeated records and NULL ids are formatted each.
    Other columns are ignored; an empty table gives an empty result.
    """
    base = records.select(F.col(f"`{id_col}`").alias("id"), F.try_parse_json(F.col(f"`{record_col}`").cast("string")).alias("v"))
    base = base.withColumn("paths", _paths_column(F.col("v"))).withColumn("fingerprint", F.xxhash64("paths"))
    which = F.lit(None).cast("int")
    hashes = _hashes(records.sparkSession, mappings)
    for i in reversed(range(len(mappings))):
        which = F.when(F.col("fingerprint").isin(hashes[i]), F.lit(i)).otherwise(which)
    base = base.withColumn("which", F.when(F.col("v").isNotNull(), which))
    turns, layout = F.lit(None).cast(_TURNS), F.when(F.col("v").isNull(), "invalid").otherwise("unknown")
    for i, m in enumerate(mappings):
        turns = F.when(F.col("which") == i, _compile(m, F.col("v"))).otherwise(turns)
        layout = F.when(F.col("which") == i, m.name).otherwise(layout)
    done = base.select("id", "fingerprint", layout.alias("layout"), turns.alias("turns"))
    return done.select("id", "fingerprint", "layout", F.posexplode_outer("turns").alias("turn", "t")).select(
        "id", "turn", F.col("t.role").alias("role"), F.col("t.text").alias("text"), "layout", F.when(F.col("layout") != "invalid", F.col("fingerprint")).alias("fingerprint")
    )


def _hashes(spark: SparkSession, mappings: tuple) -> list[list[int]]:
    """The mappings' fingerprints, hashed by Spark itself so that both sides agree."""
    flat = [(i, t) for i, m in enumerate(mappings) for t in sorted({paths_text(s) for s in m.shapes()})]
    row = spark.range(1).select(*(F.xxhash64(F.lit(t)).alias(str(n)) for n, (_, t) in enumerate(flat))).first()
    out: list[list[int]] = [[] for _ in mappings]
    for n, (i, _) in enumerate(flat):
        out[i].append(row[n])
    return out


def as_records(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, record): rows of single turns, the flat layout of a table, gathered to one JSON record a conversation (ordered by turn, role and text).
    Conversations of one user and one assistant turn, and longer ones, come in several layouts by the parity of the id, as collections from different makers do."""
    t = turns.select(F.col(f"`{id_col}`").alias("id"), F.struct(F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").alias("role"), F.col(f"`{text_col}`").alias("text")).alias("t"))
    g = t.groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    text = lambda i: F.coalesce(F.col("ts")[i]["text"], F.lit(""))
    pair = (F.size("ts") == 2) & (F.col("ts")[0]["role"] == "user") & (F.col("ts")[1]["role"] == "assistant") & F.col("ts")[0]["text"].isNotNull() & F.col("ts")[1]["text"].isNotNull()
    arr = lambda a, b: F.transform("ts", lambda x: F.struct(x["role"].alias(a), x["text"].alias(b)))
    keep = {"ignoreNullFields": "false"}
    k = F.pmod(F.coalesce(F.col("id"), F.lit(0)), F.lit(4))
    share = F.transform("ts", lambda x: F.struct(F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"]).alias("from"), x["text"].alias("value")))
    record = (
        F.when(pair & (k == 0), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("completion")), keep))
        .when(pair & (k == 1), F.to_json(F.struct(text(0).alias("instruction"), text(1).alias("output")), keep))
        .when(pair & (k == 2), F.to_json(F.struct(F.struct(text(0).alias("question"), text(1).alias("answer")).alias("data")), keep))
        .when(k == 0, F.to_json(F.struct(arr("role", "content").alias("messages")), keep))
        .when(k == 1, F.to_json(F.struct(share.alias("conversations")), keep))
        .when(k == 2, F.to_json(F.struct(arr("speaker", "text").alias("dialog")), keep))
        .otherwise(F.to_json(F.struct(arr("role", "text").alias("turns")), keep))
    )
    return g.select("id", record.alias("record"))


ORACLE_SQL = """
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INT AS turn, role, text FROM conversations
"""
