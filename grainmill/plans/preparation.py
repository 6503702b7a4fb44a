"""Whole preparations, composed of the operators. `tokenise` turns a text column into an array of token ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences, text as X
from ..operators import conversation, packing

Tokenise = Callable[[Column], Column]


def supervised(df: DataFrame, tokenise: Tokenise, length: int, key: str, pack: str | None = None, eos: str = "<|im_end|>") -> DataFrame:
    """Conversations, texts or prompts with completions, as token rows: truncated, or packed (`best_fit` or `wrapped`). Rows
    that are tokens already are only truncated or packed."""
    if "input_ids" not in df.columns:
        df = conversation.to_chatml(df)
        if "text" not in df.columns:
            df = conversation.format_text(df).withColumnRenamed("formatted", "text")
        df = df.withColumn("input_ids", tokenise(X.with_eos(F.col("text"), eos)))
    rows = df.select(F.col(key).alias("id"), F.col("input_ids").alias("tokens"))
    if pack is None:
        return rows.select(F.col("id").alias(key), sequences.truncate(F.col("tokens"), length).alias("input_ids"))
    grouped = packing.pack_groups(rows, "id", rows.count())
    if pack == "best_fit":
        return packing.pack_best_fit(grouped, length)
    if pack == "wrapped":
        return packing.pack_wrapped(grouped, length)
    raise ValueError(f"unknown packing {pack!r}")


def preference(df: DataFrame, tokenise: Tokenise, eos: int, max_prompt: int = 512, max_completion: int = 512) -> DataFrame:
    """Pairs as token rows: prompt found, templates applied, tokens cut."""
    text = conversation.apply_template(conversation.maybe_extract_prompt(df))
    row = sequences.preference_row(tokenise(F.col("prompt")), tokenise(F.col("chosen")), tokenise(F.col("rejected")), eos, max_prompt, max_completion)
    kept = [c for c in df.columns if c not in ("prompt", "chosen", "rejected")]
    return text.select(*kept, row.alias("r")).select(*kept, F.col("r.prompt").alias("prompt_input_ids"), F.col("r.chosen").alias("chosen_input_ids"), F.col("r.rejected").alias("rejected_input_ids"))


def reference_free(df: DataFrame, tokenise: Tokenise, bos: int, eos: int, max_length: int = 1024, max_prompt: int = 512, mode: str = "keep_end") -> DataFrame:
    """Pairs for losses without a reference model: of both sides the tokens of prompt and answer with start and end tokens,
    cut, with labels that leave out the prompt; a token that the tokenizer merges over the border counts to the answer."""
    text = conversation.apply_template(conversation.maybe_extract_prompt(df))
    for side in ("chosen", "rejected"):
        text = text.withColumn("_s", sequences.split_answer(tokenise(F.col("prompt")), tokenise(F.concat("prompt", side))))
        row = sequences.answer_row(sequences.with_bos(F.col("_s.prompt"), bos), sequences.with_eos_token(F.col("_s.answer"), eos), max_length, max_prompt, mode)
        text = text.withColumn(f"{side}_row", row)
    return text.drop("_s", "prompt", "chosen", "rejected")


def reward(df: DataFrame, tokenise: Tokenise, length: int) -> DataFrame:
    """Pairs of which both sides fit the length, as tokens."""
    text = conversation.apply_template(conversation.maybe_extract_prompt(df))
    both = text.withColumns({f"{c}_input_ids": tokenise(F.concat("prompt", c)) for c in ("chosen", "rejected")})
    return both.where((F.size("chosen_input_ids") <= length) & (F.size("rejected_input_ids") <= length)).drop("prompt", "chosen", "rejected")


def unpaired(df: DataFrame, tokenise: Tokenise, batch: str, order: str, max_length: int = 1024, max_prompt: int = 512) -> DataFrame:
    """Wanted and unwanted rows with labels, and each prompt with another row's completion, for the divergence estimate."""
    rows = conversation.unpair(conversation.apply_template(conversation.maybe_extract_prompt(df))) if "completion" not in df.columns else conversation.apply_template(df)
    shifted = conversation.ring_shift(rows.withColumn("_o", F.struct(F.col(order), F.col("label"))), batch, "_o", "completion", "other").drop("_o")
    answer = lambda c: sequences.answer_row(tokenise(F.col("prompt")), tokenise(F.col(c)), max_length, max_prompt)
    return shifted.withColumns({"row": answer("completion"), "kl_row": answer("other")}).drop("completion", "other", "prompt")


def stepwise(df: DataFrame, tokenise: Tokenise, separator: int, length: int, last_only: bool = False) -> DataFrame:
    """prompt, completions, labels as tokens with a label at the end of each step."""
    row = sequences.stepwise_row(tokenise(F.col("prompt")), F.transform("completions", tokenise), F.col("labels"), separator, last_only)
    return df.withColumn("r", row).select(*[c for c in df.columns if c not in ("prompt", "completions", "labels")], *[sequences.truncate(F.col(f"r.{c}"), length).alias(c) for c in ("input_ids", "labels")])
