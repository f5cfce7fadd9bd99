"""Chat formatting by token-level assembly.

Every turn becomes ``TURN role BODY text END``: role and text are encoded separately and
the three marks are reserved ids above the vocabulary, so no text can produce them.
Control strings that occur in a text are escaped before encoding: a backslash goes behind
their first character (one more where backslashes stand there already), which the reader
takes out again.  The loss mask of a batch comes from prefix sums: +1 where an assistant's
text starts, -1 where it ends, summed over all tokens.

A row of the output is one turn, ordered by conversation and turn, so a conversation of any
length is never held in one row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import free_name, kept, per_text, short_batches, text_or_empty
from .records import UnitEncoder
from .token_prefix import byte_of_letter

TOKENIZER = "byte_bpe_50k.json"
# The template's marks, then control strings of common chat templates.
MARKS = ("<|turn|>", "<|body|>", "<|end|>")
CONTROLS = (*MARKS, "<|im_start|>", "<|im_end|>", "<|startoftext|>", "<|endoftext|>", "<s>", "</s>",
            "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"

_SPLIT = "|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in CONTROLS)
_CONTROL = re.compile(_SPLIT)


def escape(text: str) -> str:
    """A backslash behind the first character of each control string, escaped or not."""
    return _CONTROL.sub(lambda m: m.group()[0] + "\\" + m.group()[1:], text)


def unescape(text: str) -> str:
    """Undo ``escape``."""
    return _CONTROL.sub(lambda m: m.group()[0] + m.group()[2:] if m.group()[1] == "\\" else m.group(), text)


class ChatCoder:
    """Encodes segments, splices the reserved ids and reads them back."""

    def __init__(self, path: str):
        self.units = UnitEncoder(path)
        self.units.tokenizer.encode_special_tokens = True      # special strings in a text are ordinary text
        tokenizer = self.units.tokenizer
        size = tokenizer.get_vocab_size()
        self.turn, self.body, self.end = range(size, size + len(MARKS))
        letters = byte_of_letter()
        shown = [bytes(letters[c] for c in tokenizer.id_to_token(i)) for i in range(size - 1)]
        self.shown = [*shown, tokenizer.id_to_token(size - 1).encode(), *(m.encode() for m in MARKS)]

    def assemble(self, roles: list[str], texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids (u16 little-endian) and loss mask (one byte per id) of each turn of a batch."""
        segments, lengths, starts = [], [], []
        coded = [np.frombuffer(b, dtype=self.units.dtype) for b in self.units.encode_all([escape(t) for t in [*roles, *texts]])]
        for role, text in zip(coded, coded[len(roles):]):
            parts = [np.array([self.turn]), role, np.array([self.body]), text, np.array([self.end])]
            starts.append(len(lengths))
            segments.extend(parts)
            lengths.extend(map(len, parts))
        if not segments:
            return [], []
        ids = np.concatenate(segments).astype("<u2")
        ends = np.cumsum(lengths)
        steps = np.zeros(len(ids) + 1, dtype=np.int64)
        for role, s in zip(roles, starts):
            if role == LOSS_ROLE:                     # the text is the turn's fourth segment
                steps[ends[s + 2]] += 1
                steps[ends[s + 3]] -= 1
        mask = np.cumsum(steps[:-1]).astype(np.uint8)
        cuts = [0, *(int(ends[s + 4]) for s in starts)]
        return ([ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])],
                [mask[a:b].tobytes() for a, b in zip(cuts, cuts[1:])])

    def text(self, ids: np.ndarray) -> str:
        return b"".join(map(self.shown.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def read(self, ids: bytes, mask: bytes) -> tuple[str, str, str | None, int]:
        """Role, text, text under the loss mask (None if none) and formatted length of one turn."""
        a, m = np.frombuffer(ids, dtype="<u2"), np.frombuffer(mask, dtype=np.uint8).astype(bool)
        body = int(np.flatnonzero(a == self.body)[0])
        loss = unescape(self.text(a[m])) if m.any() else None
        return unescape(self.text(a[1:body])), unescape(self.text(a[body + 1:-1])), loss, len(self.text(a))


def coder(path: str) -> ChatCoder:
    return kept(("chat", path), lambda: ChatCoder(path))


def format_turns(df: DataFrame, tokenizer_path: str) -> DataFrame:
    """All input rows and columns plus ``ids`` and ``loss_mask`` (binary).

    Needs ``role`` and ``text``; null in either counts as empty.  Empty input: no rows;
    input columns named like a result column are replaced.
    """
    short_batches(df.sparkSession)
    df = df.drop("ids", "loss_mask")

    def make():
        c = coder(tokenizer_path)
        return lambda roles, texts: pd.DataFrame(dict(zip(("ids", "loss_mask"), c.assemble(roles, texts))))

    s = free_name(df.columns, "formatted")
    out = df.withColumn(s, per_text("ids binary, loss_mask binary", make, text_or_empty("role"), text_or_empty("text")))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], f"{s}.ids", f"{s}.loss_mask")


def write_conversations(df: DataFrame, root: str, tokenizer_path: str) -> None:
    """The formatted turns as Parquet, ordered by conversation, turn and (for equal turns) role and text.

    The order is by range, so a conversation of very many turns is split over files.
    """
    order = ["conv_id", "turn", "role_key", "text_key"]
    turns = df.select("conv_id", "turn", "role", "text",
                      F.xxhash64("role").alias("role_key"), F.xxhash64("text").alias("text_key"))
    dealt = turns.repartitionByRange(*order)
    (format_turns(dealt, tokenizer_path).sortWithinPartitions("conv_id", "turn", "role", "text")
     .select("conv_id", "turn", "ids", "loss_mask").write.parquet(root))


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def digest_conversations(spark: SparkSession, root: str, tokenizer_path: str) -> DataFrame:
    """One row per conversation, read back from the written turns.

    Decoding is spread over all turns.  A digest is sequential by its definition, so a
    conversation's turns are streamed in order through one hash state: the task that
    digests a very long conversation reads many rows but holds only one batch.
    """
    short_batches(spark)

    def make():
        c = coder(tokenizer_path)
        return lambda ids, masks: pd.DataFrame([c.read(i, m) for i, m in zip(ids, masks)],
                                               columns=["role", "text", "loss", "chars"])

    read = spark.read.parquet(root)
    turns = read.withColumn("t", per_text("role string, text string, loss string, chars long", make, F.col("ids"), F.col("loss_mask")))
    turns = (turns.select(F.col("conv_id").cast("string").alias("conv_id"), "turn", "t.*")
             .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, state = False, None
        done = []
        for pdf in batches:
            for conv, role, text, loss, chars in zip(pdf["conv_id"], pdf["role"], pdf["text"], pdf["loss"], pdf["chars"]):
                if not open_ or conv != state[0]:
                    if open_:
                        done.append(_digest_row(state))
                    open_, state = True, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                if loss is not None:
                    state[3] += len(loss)
                    state[4].update(loss.encode("utf-8", "replace"))
                state[5] += int(chars)
            yield pd.DataFrame(done, columns=_NAMES).astype(_TYPES)
            done = []
        if open_:
            yield pd.DataFrame([_digest_row(state)], columns=_NAMES).astype(_TYPES)

    return turns.select("conv_id", "role", "text", "loss", "chars").mapInPandas(digest, DIGEST)


_NAMES = [f.split()[0] for f in DIGEST.split(", ")]
_TYPES = {"conv_id": "Int64", "n_turns": "int64", "loss_chars": "int64", "formatted_chars": "int64"}


def _digest_row(state: list) -> tuple:
    conv, turns, all_, loss_chars, loss, chars = state
    return (None if conv is None else int(conv), turns, all_.hexdigest(), loss_chars, loss.hexdigest(), chars)


def formatted_conversations(df: DataFrame, tokenizer_path: str, root: str | None = None) -> DataFrame:
    """Format all rows into a fresh shared folder and return the digests read back from it.

    Null conversation ids form one conversation; null turns come first; repeated rows are
    turns of their own; an empty table gives no rows.
    """
    spark = df.sparkSession
    root = root or scratch_path(spark, "chat")
    rows = df.select("conv_id", "turn", text_or_empty("role").alias("role"), text_or_empty("text").alias("text"))
    write_conversations(rows, root, tokenizer_path)
    return digest_conversations(spark, root, tokenizer_path)
