"""Chat formatting: a state machine over roles and a declarative template with loss flags."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from opinara.llm._common import map_arrow, table


@dataclass(frozen=True)
class Template:
    """Marks around each turn, the roles whose texts are trained on, and the turn order.

    A turn is ``open`` role ``after_role`` text ``close``. ``controls`` are the strings
    that no text may show: the marks, and those of other formats. ``order`` maps a state
    (the last role, or "" at the start) to the roles that may follow; ``ends`` are the
    roles a conversation may end with.
    """

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>"
    between: str = "\n"
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    loss_roles: frozenset[str] = frozenset({"assistant"})
    order: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)


def escaper(t: Template):
    r"""Functions that hide and restore control strings.

    A backslash goes after the first character of each control string, and of each one
    already split by backslashes one more: ``<s>`` is ``<\s>``, ``<\s>`` is ``<\\s>``.
    No control string is left, other text stays as it is, and taking one backslash away
    restores the text.
    """
    one = "|".join(rf"(?<={re.escape(c[0])})(\\*)(?={re.escape(c[1:])})" for c in sorted(t.controls, key=len, reverse=True))
    some = "|".join(rf"(?<={re.escape(c[0])})\\(\\*)(?={re.escape(c[1:])})" for c in sorted(t.controls, key=len, reverse=True))
    hide, show = re.compile(one), re.compile(some)
    return lambda s: hide.sub(lambda m: "\\" + m[0], s), lambda s: show.sub(lambda m: m[0][1:], s)


def turns_in_order(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """One shuffle on the conversation, sorted within partitions: a conversation is a run of rows and is read as a stream."""
    cols = [F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")]
    return rows.select(*cols).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def segments_of(batches, t: Template) -> Iterator[dict[str, list]]:
    """Segments batch by batch; of a conversation only its last role is kept between rows."""
    hide, _ = escaper(t)
    conv, state, n, seg = object(), "", 0, 0
    for b in batches:
        out = {k: [] for k in ("conv_id", "turn_no", "segment", "text", "loss", "valid")}
        for c, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
            if c != conv:
                conv, state, n, seg = c, "", 0, 0
            ok = role in t.order.get(state, ())
            safe = hide(role).replace("\\n", "\\\\n").replace("\n", "\\n") if "\n" in role or "\\n" in role else hide(role)
            pieces = [(t.open + safe + t.after_role, False), (hide(text), role in t.loss_roles), (t.close + t.between, False)]
            for s, loss in pieces:
                out["conv_id"].append(c)
                out["turn_no"].append(n)
                out["segment"].append(seg)
                out["text"].append(s)
                out["loss"].append(loss)
                out["valid"].append(ok)
                seg += 1
            state, n = role, n + 1
        yield out


def format_conversations(rows: DataFrame, template: Template = Template(), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn_no, segment, text, loss, valid): three text segments per turn.

    The segments of a conversation, in order, are its formatted text; ``loss`` marks those
    to train on. ``valid`` tells whether the state machine allows the turn's role where it
    stands; turns that it does not allow are still formatted. Rows are ordered by turn,
    then role and text, so ties have one order; repeated rows are turns of their own. A
    null role or text is empty; a null conversation is one conversation. Unknown roles are
    formatted and never valid. A very long conversation is read as a stream.
    """
    kind = dict(rows.dtypes)[id_col]
    ordered = turns_in_order(rows, id_col, turn_col, role_col, text_col)
    return map_arrow(ordered, lambda batches: segments_of(batches, template), f"conv_id {kind}, turn_no long, segment long, text string, loss boolean, valid boolean")


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation the digests of the turns parsed from its formatted text and of the text under the loss mask.

    ``segments`` as format_conversations returns them, in its order. Turns are told by the
    template's marks alone. An empty table gives no rows.
    """
    kind = dict(segments.dtypes)["conv_id"]
    mark = re.compile(f"{re.escape(template.open)}(.*?){re.escape(template.after_role)}(.*?){re.escape(template.close)}{re.escape(template.between)}", re.S)

    def run(batches):
        _, show = escaper(template)
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid")
        state: list | None = None

        def parsed(turn: str) -> None:
            while m := mark.match(turn):
                role = show(re.sub(r"\\(\\n|n)", lambda x: "\n" if x[1] == "n" else "\\n", m[1]) if "\\n" in m[1] else m[1])
                state[1] += 1
                state[2].update(f"{role}\n{show(m[2])}\n".encode())
                turn = turn[m.end() :]
            assert not turn, "the formatted text doesn't follow the template"

        def done() -> list:
            return [state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5], state[6] and state[8] in template.ends]

        held = ""
        for b in batches:
            rows = []
            for c, text, loss, ok in zip(*(b.column(k).to_pylist() for k in (0, 3, 4, 5))):
                if state is None or c != state[0]:
                    if state is not None:
                        rows.append(done())
                    state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True, None, ""]
                held += text
                state[5] += len(text)
                state[6] &= ok
                if loss:
                    plain = show(text)
                    state[3] += len(plain)
                    state[4].update(plain.encode())
                if text.startswith(template.open):
                    state[8] = text[len(template.open) : -len(template.after_role)]
                if text == template.close + template.between:
                    parsed(held)
                    held = ""
            if rows:
                yield dict(zip(names, map(list, zip(*rows))))
        if state is not None:
            yield dict(zip(names, ([x] for x in done())))

    return map_arrow(segments, run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(hard).alias("text")) for k, r in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    return read_back(format_conversations(rows.unionByName(more)))


#: The same digests in DuckDB: the escape adds one backslash per control string, split by backslashes or not.
_CONTROLS = r"(<\\*(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>)|\[\\*(INST\]|/INST\]))"
OP4_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '') AS prev,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(length(role) + length(text) + length(regexp_extract_all(text, '{_CONTROLS}')) + 24)::BIGINT AS formatted_chars,
  bool_and(((prev = '' AND role IN ('system', 'user')) OR (prev = 'system' AND role = 'user') OR (prev = 'user' AND role = 'assistant') OR (prev = 'assistant' AND role = 'user')) AND (back > 1 OR role = 'assistant')) AS valid
FROM o GROUP BY conv_id
"""
