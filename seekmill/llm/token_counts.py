"""Token counts by separator scan of flat token files (operator 1).

A flat token file is nothing but little-endian token ids, documents one after another, each ended by
an end-of-document id; no index says where they begin. Files are cut into blocks of equal size that are
scanned side by side with vectorised comparisons; a prefix scan over the blocks of a file (running
maximum of the last separator's place, running sum of the separators) stitches the documents that
cross block borders and numbers them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seekmill.llm.common import Scratch

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
EOD = 50256
#: Tokens a block; a block is what a task holds of a file at a time.
BLOCK_TOKENS = 1 << 21
#: Blocks a scan task, about 128 MB of two-byte tokens.
TASK_BLOCKS = 32

_encoders: dict[str, object] = {}


def encoder(path: str = TOKENIZER):
    """The tokenizer of a file of ranks; a worker loads it once."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[path] = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def id_type(tokenizer: str = TOKENIZER, eod: int = EOD) -> str:
    """Two bytes an id if the vocabulary and the separator fit, else four."""
    return "<u2" if max(encoder(tokenizer).max_token_value, eod) < 1 << 16 else "<u4"


def _open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_flat(docs: DataFrame, uri: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, eod: int = EOD) -> DataFrame:
    """Tokenise docs to flat files part-N.bin under uri, one a partition; returns the lazy (doc_id, file, ordinal)
    of every document, whose evaluation writes the files.

    A task writes to a name of its own and renames at its end, so a lost or repeated task leaves whole files only. The
    tokenizer's file is opened at its path on the driver and on every executor; it isn't shipped.
    """
    kind = id_type(tokenizer, eod)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        fs, root = _open_fs(uri)
        name = f"part-{ctx.partitionId():08d}.bin"
        part = f"{root}/.{name}.{ctx.taskAttemptId()}"
        bpe, end, n, out = encoder(tokenizer), np.array([eod], kind).tobytes(), 0, None
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                block = pdf.iloc[at : at + 256]
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(part)
                for text in block["text"]:
                    if text:
                        out.write(bpe.encode_to_numpy(text, disallowed_special=()).astype(kind).tobytes())
                    out.write(end)
                yield pd.DataFrame({"doc_id": block["doc_id"], "file": name, "ordinal": np.arange(n, n + len(block))})
                n += len(block)
        if out is not None:
            out.close()
            fs.move(part, f"{root}/{name}")

    slim = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return slim.mapInPandas(run, "doc_id bigint, file string, ordinal bigint")


def scan_blocks(spark: SparkSession, uri: str, eod: int = EOD, block_tokens: int = BLOCK_TOKENS, kind: str = "<u2") -> DataFrame:
    """(file, block, first, size, ends): the places (in tokens, from the file's start) of the separators of each block."""
    width = np.dtype(kind).itemsize
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(uri).select("path", "length")  # the contents aren't read
    blocks = files.select(
        F.element_at(F.split("path", "/"), -1).alias("file"),
        (F.col("length") / width).cast("bigint").alias("file_tokens"),
        F.explode(F.expr(f"sequence(0L, greatest(0L, bigint(ceil(length / {width} / {block_tokens})) - 1L))")).alias("block"),
    ).select("file", "block", (F.col("block") * block_tokens).alias("first"), "file_tokens")
    total = files.agg(F.sum(F.ceil(F.col("length") / width / block_tokens))).first()[0] or 0
    tasks = max(1, min(total, max(-(-total // TASK_BLOCKS), spark.sparkContext.defaultParallelism)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _open_fs(uri)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                size = min(block_tokens, row.file_tokens - row.first)
                with fs.open_input_file(f"{root}/{row.file}") as f:
                    ids = np.frombuffer(f.read_at(width * size, width * row.first), kind)
                ends = np.flatnonzero(ids == eod).astype(np.int64) + row.first
                yield pd.DataFrame({"file": [row.file], "block": [row.block], "first": [row.first], "size": [size], "ends": [ends]})

    spread = blocks.repartition(int(tasks), "file", "block")
    return spread.mapInPandas(run, "file string, block bigint, first bigint, size bigint, ends array<bigint>")


def stitch(blocks: DataFrame) -> DataFrame:
    """(file, ordinal, n_tokens) of every document of the files, from their blocks.

    A prefix scan over a file's blocks carries in the place of the last separator so far (running maximum)
    and the number of separators so far (running sum). Tokens after a file's last separator are no document.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.filter(F.size("ends") > 0).select(
        "file",
        "ends",
        F.coalesce(F.max(F.element_at("ends", -1)).over(before), F.lit(-1)).alias("last_end"),
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("docs_before"),
    )
    each = carried.select("file", "docs_before", "last_end", "ends", F.posexplode("ends").alias("k", "end"))
    previous = F.when(F.col("k") == 0, F.col("last_end")).otherwise(F.try_element_at("ends", F.greatest("k", F.lit(1))))
    return each.select("file", (F.col("docs_before") + F.col("k")).alias("ordinal"), (F.col("end") - previous - 1).alias("n_tokens"))


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, eod: int = EOD, block_tokens: int = BLOCK_TOKENS, scratch: Scratch | None = None
) -> DataFrame:
    """(doc_id, n_tokens) of every row of docs, by way of flat token files in the shared folder.

    NULL and empty texts have 0 tokens (their separators follow one another). Repeated rows and NULL ids are counted
    each; very long texts are tokenised whole and may cross any number of blocks. The separator's string in a text is ordinary text, so it never splits a document. Other columns are ignored;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "tokens")
    uri = scratch.path("flat")
    places = scratch.table(write_flat(docs, uri, id_col, text_col, tokenizer, eod), "places")
    if not places.take(1):
        return spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    counts = stitch(scan_blocks(spark, uri, eod, block_tokens, id_type(tokenizer, eod)))
    # both sides grow with the corpus, and their compact files look small enough to broadcast: ask for a shuffle
    return places.join(counts.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens")
