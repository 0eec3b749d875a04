"""Chat formatting by schema fingerprint, in DataFrame functions throughout.

Records come in many layouts: prompt and response, instruction and output, lists of messages
under several names. A record's fingerprint is the hash of the nested field paths that it has;
it selects one of the declared ``LAYOUTS``, whose expression turns the record into canonical
turns. Paths that no layout knows do not count, so further columns change nothing.

Turns become one text: ``TURN`` role ``SEP`` text ``END``, one after another. Control strings
inside roles and texts are escaped: after the first character of each stands a backslash more
than before, which is undone exactly. The output is a list of segments with their loss flag;
its texts joined are the formatted text, and the flagged ones the text under the loss mask.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: strings that must not stand inside a text: this template's own, and those of others
CONTROLS = (TURN, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TRAINED = ("assistant",)

_SPLIT = [(re.escape(c[0]), re.escape(c[1:])) for c in CONTROLS]
#: a control string with any number of backslashes after its first character
_FAMILY = "|".join(rf"(?<={a})(?=\\*{b})" for a, b in _SPLIT)
_ESCAPED = "|".join(rf"(?<={a})\\(?=\\*{b})" for a, b in _SPLIT)

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """``needs`` and ``may`` are field paths (``[]`` after a list); ``turns`` is SQL over them."""

    name: str
    needs: tuple[str, ...]
    turns: str
    may: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    def path_sets(self) -> list[tuple[str, ...]]:
        return [tuple(sorted({*self.needs, *more})) for n in range(len(self.may) + 1) for more in combinations(self.may, n)]


def _listed(name: str, column: str, role: str, text: str, order: str | None = None, roles: dict[str, str] | None = None) -> Layout:
    """Layout of a list of messages with a role and a text; an empty list has no turns."""
    source = f"transform(array_sort({column}), x -> x)" if order else column
    inner = tuple(f"{column}[].{x}" for x in (role, text, order) if x)
    turns = f"transform({source}, x -> named_struct('role', x.{role}, 'text', x.{text}))"
    return Layout(name, (f"{column}[]",), turns, inner, roles or {})


def _turn(role: str, text: str) -> str:
    return f"array(named_struct('role', '{role}', 'text', {text}))"


def _some(role: str, text: str) -> str:
    return f"if({text} is null, cast(array() as {TURNS}), {_turn(role, text)})"


_USER = "array(named_struct('role', 'user', 'text', if(input is null, instruction, concat(instruction, '\\n\\n', input))))"

LAYOUTS = (
    _listed("messages", "messages", "role", "content"),
    _listed("shared", "conversations", "from", "value", roles={"human": "user", "gpt": "assistant"}),
    _listed("rows", "turns", "role", "text", order="turn"),
    Layout("prompt", ("prompt", "response"), f"concat({_some('system', 'system')}, {_turn('user', 'prompt')}, {_turn('assistant', 'response')})", ("system",)),
    Layout("completion", ("prompt", "completion"), f"concat({_some('system', 'system')}, {_turn('user', 'prompt')}, {_turn('assistant', 'completion')})", ("system",)),
    Layout("instruction", ("instruction", "output"), f"concat({_some('system', 'system')}, {_USER}, {_turn('assistant', 'output')})", ("system", "input")),
    Layout("question", ("question", "answer"), f"concat({_some('system', 'system')}, {_turn('user', 'question')}, {_turn('assistant', 'answer')})", ("system",)),
)
KNOWN = tuple(sorted({p for x in LAYOUTS for p in (*x.needs, *x.may)}))


def _leaf(path: str) -> str:
    return f"`{path}`"


def _present(schema: T.StructType, path: str) -> Column | None:
    """Whether a record has the path: its value, or that of some element of the list, is not
    null; None if no record of this schema can."""
    names = {f.name.lower(): f for f in schema.fields}
    head, _, rest = path.partition("[]")
    found = names.get(head.lower())
    if found is None:
        return None
    if not path.endswith("[]") and not rest:
        return F.col(_leaf(found.name)).isNotNull() if isinstance(found.dataType, T.StringType) else None
    if not isinstance(found.dataType, T.ArrayType) or not isinstance(found.dataType.elementType, T.StructType):
        return None
    if not rest:
        return F.col(_leaf(found.name)).isNotNull()
    inner = next((f.name for f in found.dataType.elementType.fields if f.name.lower() == rest[1:].lower()), None)
    return None if inner is None else F.exists(_leaf(found.name), lambda x: x[inner].isNotNull())


def fingerprint(schema: T.StructType) -> Column:
    """Hash of the known field paths that a record of this schema has."""
    has = [(p, _present(schema, p)) for p in KNOWN]
    return F.xxhash64(F.concat_ws(",", *[F.when(c, F.lit(p)) for p, c in has if c is not None]))


def _usable(layout: Layout, schema: T.StructType) -> bool:
    return all(_present(schema, p) is not None for p in layout.needs)


def _filled(layout: Layout, schema: T.StructType) -> str:
    """The layout's expression, with null for fields that the schema does not have."""
    text = layout.turns
    for p in layout.may:
        if "[]" not in p and _present(schema, p) is None:
            text = re.sub(rf"(?<!')\b{p}\b(?!')", "cast(null as string)", text)
        elif "[]" in p and _present(schema, p) is None:
            text = text.replace(f"x.{p.partition('[].')[2]})", "cast(null as string))").replace(f"x.{p.partition('[].')[2]},", "cast(null as string),")
    return text


def canonical(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records`` with ``fingerprint``, ``layout`` (null where none is declared for the
    fingerprint) and ``turns``: the canonical (role, text) in order, null without a layout.

    A null role or text becomes empty. The table of fingerprints is as large as the layouts'
    declared path sets, however many records there are.
    """
    schema = records.schema
    out = records.select(fingerprint(schema).alias("fingerprint"), *[F.col(_leaf(c)) for c in records.columns if c not in ("fingerprint", "layout")])
    spark = records.sparkSession
    declared: dict[str, str] = {}
    for x in layouts:
        for paths in x.path_sets():
            declared.setdefault(",".join(paths), x.name)
    hashed = spark.range(1).select(*[F.xxhash64(F.lit(p)).alias(f"h{i}") for i, p in enumerate(declared)]).first()
    by_name: dict[str, list[int]] = {}
    for h, name in zip(hashed, declared.values(), strict=True):
        by_name.setdefault(name, []).append(h)
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in layouts:
        if not _usable(x, schema):
            continue
        hit = F.col("fingerprint").isin(by_name[x.name])
        name = F.when(hit, F.lit(x.name)).otherwise(name)
        role = "y.role"
        for known, own in x.roles.items():
            role = f"if(y.role = '{known}', '{own}', {role})"
        plain = f"transform({_filled(x, schema)}, y -> named_struct('role', coalesce({role}, ''), 'text', coalesce(y.text, '')))"
        turns = F.when(hit, F.expr(plain).cast(TURNS)).otherwise(turns)
    out = out.withColumn("layout", name)
    return out.withColumn("_turns", turns).drop("turns").withColumnRenamed("_turns", "turns")


def fingerprint_counts(canonical_records: DataFrame) -> DataFrame:
    """(fingerprint, layout, n): which layouts a corpus has, and what no mapping covers."""
    return canonical_records.groupBy("fingerprint", "layout").agg(F.count(F.lit(1)).alias("n"))


def escaped(text: Column) -> Column:
    """``text`` with a backslash more inside every control string; only those change. Most
    texts have no first character of one and are not searched further."""
    some = F.lit(False)
    for first in sorted({c[0] for c in CONTROLS}):
        some = some | F.contains(text, F.lit(first))
    return F.when(some, F.regexp_replace(text, _FAMILY, r"\\")).otherwise(text)


def unescaped(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, _ESCAPED, "")).otherwise(text)


def segments(turns: Column, trained: tuple[str, ...] = TRAINED) -> Column:
    """(text, loss) in order: markup with role, text, end, of each turn."""

    def each(t: Column) -> Column:
        off = F.lit(False)
        return F.array(
            F.struct(F.concat(F.lit(TURN), escaped(t["role"]), F.lit(SEP)).alias("text"), off.alias("loss")),
            F.struct(escaped(t["text"]).alias("text"), t["role"].isin(list(trained)).alias("loss")),
            F.struct(F.lit(END).alias("text"), off.alias("loss")),
        )

    return F.flatten(F.transform(turns, each))


def format_chats(records: DataFrame, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """``records`` with fingerprint, layout and ``segments`` in place of their layout's columns
    (``canonical`` says what becomes of nulls and unknown layouts)."""
    known = {p.partition("[]")[0].lower() for p in KNOWN}
    keep = [c for c in records.columns if c.lower() not in known and c not in ("fingerprint", "layout", "segments")]
    out = canonical(records)
    return out.select(*[F.col(_leaf(c)) for c in keep], "fingerprint", "layout", segments(F.col("turns"), trained).alias("segments"))


def formatted_text(column: str = "segments") -> Column:
    return F.array_join(F.col(f"{column}.text"), "")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: what stands between control strings, unescaped."""
    parts = F.split(formatted, re.escape(END))
    whole = F.slice(parts, 1, F.size(parts) - 1)

    def turn(x: Column) -> Column:
        pair = F.split(F.substr(x, F.lit(len(TURN) + 1)), re.escape(SEP))
        return F.struct(unescaped(pair[0]).alias("role"), unescaped(pair[1]).alias("text"))

    return F.transform(whole, turn)


def read_loss(column: str = "segments") -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(F.col(column), lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def chat_report(formatted: DataFrame, id_col: str) -> DataFrame:
    """Per formatted record, read back from its segments: counts, and digests of the turns and
    of the text under the loss mask; all null where no layout fits."""
    text = formatted.select(F.col(_leaf(id_col)), "segments", formatted_text().alias("formatted"))
    back = text.select(F.col(_leaf(id_col)), "formatted", read_turns(F.col("formatted")).alias("read"), read_loss().alias("loss"))
    line = F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        F.col(_leaf(id_col)),
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


# --- conversations kept by turn -----------------------------------------------------------


def records_of(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One record per conversation of a table with a row per turn, each in the layout its shape
    allows: prompt and response (one exchange), instruction and output (one exchange under a
    system text), a shared list (the three usual roles, from the user), or else its rows.

    A null role or text is empty; rows without id are one conversation; turns of equal number
    stand by role and text, those without number first. One group per conversation: its texts
    end in one formatted text.
    """
    empty = lambda c: F.coalesce(F.col(_leaf(c)).cast("string"), F.lit(""))
    row = F.struct(F.col(_leaf(turn_col)).cast("long").alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    grouped = rows.groupBy(F.col(_leaf(id_col)).alias("id")).agg(F.collect_list(row).alias("all")).select("id", F.array_sort("all").alias("all"))
    roles = F.concat_ws(",", F.col("all.role"))
    shape = F.when(roles == "user,assistant", 1).when(roles == "system,user,assistant", 2)
    shape = shape.when(F.forall("all.role", lambda r: r.isin("system", "user", "assistant")) & (F.col("all")[0]["role"] == "user"), 3).otherwise(4)
    sent = F.expr("transform(all, x -> named_struct('from', case x.role when 'user' then 'human' when 'assistant' then 'gpt' else x.role end, 'value', x.text))")
    is_, at = lambda n: F.col("shape") == n, lambda i: F.col("all")[i]["text"]
    return grouped.withColumn("shape", shape).select(
        F.col("id").alias(id_col),
        F.when(is_(1), at(0)).alias("prompt"),
        F.when(is_(1), at(1)).alias("response"),
        F.when(is_(2), at(0)).alias("system"),
        F.when(is_(2), at(1)).alias("instruction"),
        F.when(is_(2), at(2)).alias("output"),
        F.when(is_(3), sent).alias("conversations"),
        F.when(is_(4), F.col("all")).alias("turns"),
    )
