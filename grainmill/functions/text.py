"""String, JSON and conversation functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def caption(json_text: Column, key: str, fallback: Column) -> Column:
    """The sidecar's value under a key: absent (or no JSON at all) falls back, a null one is empty text."""
    fields = F.from_json(json_text, "map<string,string>")
    return F.when(F.coalesce(F.map_contains_key(fields, key), F.lit(False)), F.coalesce(fields[key], F.lit(""))).otherwise(fallback)


def turn(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


#: Fixed value: the instruction that asks for a picture of a caption.
T2I_PROMPT = "Please generate image based on the following caption: "
#: Fixed value: the instruction that asks for a picture to be reproduced.
I2I_PROMPT = "<image>\nPlease reconstruct the given image."


def image_conversation(kind: Column, text: Column) -> Column:
    """Two turns by the sample's type, T2I where it has none; another type is an error."""
    kind = F.coalesce(kind, F.lit("T2I"))
    ask = F.when(kind == "T2I", F.concat(F.lit(T2I_PROMPT), text)).when(kind == "I2I", F.lit(I2I_PROMPT))
    known = F.when(kind.isin("T2I", "I2I"), ask).otherwise(F.raise_error(F.concat(F.lit("unknown sample type "), kind)).cast("string"))
    return F.array(turn("user", known), turn("assistant", F.when(kind == "I2I", "").otherwise("<image>")))


def chat_roles(conversation: Column, system: str | None = None) -> Column:
    """human and gpt become user and assistant; a leading turn that isn't the user's goes; a system turn may lead."""
    role = lambda x: F.when(x["from"] == "human", "user").when(x["from"] == "gpt", "assistant").otherwise(x["from"])
    turns = F.transform(conversation, lambda x: F.struct(role(x).alias("role"), x["value"].alias("content")))
    turns = F.when(F.get(turns, F.lit(0))["role"] != "user", F.slice(turns, 2, F.greatest(F.size(turns), F.lit(1)))).otherwise(turns)
    return turns if system is None else F.concat(F.array(turn("system", F.lit(system))), turns)


def to_chatml(conversation: Column) -> Column:
    """from/value turns as role/content, names unchanged."""
    return F.transform(conversation, lambda x: F.struct(x["from"].alias("role"), x["value"].alias("content")))


def render(messages: Column, style: str = "chatml", system: str = "", seps: tuple[str, str] = ("\n", "</s>")) -> Column:
    """A conversation as one string: chatml; single (one separator); two (separators alternate); plain (contents only).

    Null contents are empty, an empty conversation is the system text or nothing.
    """
    text = lambda x: F.coalesce(x["content"], F.lit(""))
    if style == "chatml":
        parts = F.transform(messages, lambda x: F.concat(F.lit("<|im_start|>"), x["role"], F.lit("\n"), text(x), F.lit("<|im_end|>\n")))
    elif style in ("single", "two"):
        sep = (lambda i: F.lit(seps[0])) if style == "single" else (lambda i: F.when(i % 2 == 0, seps[0]).otherwise(seps[1]))
        parts = F.transform(messages, lambda x, i: F.concat(x["role"], F.lit(": "), text(x), sep(i)))
    elif style == "plain":
        parts = F.transform(messages, lambda x, i: F.concat(text(x), F.when(i % 2 == 0, seps[0]).otherwise(seps[1])))
    else:
        raise ValueError(f"unknown style {style!r}")
    return F.concat(F.lit(system), F.array_join(parts, ""))


def with_generation_prompt(rendered: Column, messages: Column) -> Column:
    """A conversation that ends with the user asks for an answer; one that ends with the assistant is left open for it to
    go on; any other end is an error."""
    last = F.element_at(messages, -1)["role"]
    return (
        F.when(last == "user", F.concat(rendered, F.lit("<|im_start|>assistant\n")))
        .when(last == "assistant", F.regexp_replace(rendered, r"<\|im_end\|>\n$", ""))
        .otherwise(F.raise_error(F.concat(F.lit("no prompt may end with role "), F.coalesce(last, F.lit("null")))).cast("string"))
    )


def with_eos(text: Column, eos: str = "<|im_end|>") -> Column:
    return F.when(F.endswith(text, F.lit(eos)), text).otherwise(F.concat(text, F.lit(eos)))


def common_prefix(one: Column, two: Column) -> Column:
    """Longest common prefix in characters, null if a side is; its length is found by halving, so the work grows little faster than the text."""
    n = F.least(F.length(one), F.length(two))
    equal = lambda k: (k <= n) & (F.substr(one, F.lit(1), k) == F.substr(two, F.lit(1), k))
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    prefix = F.substr(one, F.lit(1), F.aggregate(steps, F.lit(0), lambda k, step: F.when(equal(k + step), k + step).otherwise(k)))
    return F.when(one.isNotNull() & two.isNotNull(), prefix)


#: Fixed value: an answer's format, one think block at the start.
THINK = r"(?s)\A<think>(?!.*<think>)(.*?)</think>.*"


def think_reward(completion: Column) -> Column:
    return F.when(completion.rlike(THINK), 1.0).otherwise(0.0)


def quoted_target(prompt: Column) -> Column:
    return F.get(F.split(prompt, '"'), F.lit(1))


def edit_distance_reward(prompt: Column, read: Column) -> Column:
    """1 if the text quoted in the prompt was read back, else 1 - min(distance, length) / length; null without a target."""
    norm = lambda c: F.lower(F.replace(c, F.lit(" "), F.lit("")))
    target, got = norm(quoted_target(prompt)), norm(F.coalesce(read, F.lit("")))
    n = F.length(target)
    return F.when(n > 0, F.when(F.contains(got, target), 1.0).otherwise(1 - F.least(F.levenshtein(target, got), n) / n))


def length_reward(completion: Column, target: int = 20) -> Column:
    return (-F.abs(F.lit(target) - F.length(completion))).cast("double")


def control_reward(token: Column, score: Column) -> Column:
    """By control token: negative -x, neutral -2|x| + 4, positive x."""
    return F.when(token == "[negative]", -score).when(token == "[neutral]", -2 * F.abs(score) + 4).when(token == "[positive]", score).otherwise(
        F.raise_error(F.concat(F.lit("unknown control token "), F.coalesce(token, F.lit("null")))).cast("double")
    )


def answer_reward(answer: Column, solution: Column) -> Column:
    """Equality after case and white space are levelled."""
    norm = lambda c: F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    return (norm(answer) == norm(solution)).cast("double")


def tool_call(text: Column) -> Column:
    """struct(tool, query) of the last-opened request, nulls if there is none."""
    body = F.regexp_extract(text, r"(?s)<request>(.*?)<call>", 1)
    tool = F.regexp_extract(body, r"(?s)<(\w+)>", 1)
    query = F.regexp_extract(body, r"(?s)<\w+>(.*)", 1)
    return F.struct(F.nullif(tool, F.lit("")).alias("tool"), F.nullif(query, F.lit("")).alias("query"))


def dialogue_turns(text: Column) -> Column:
    """Turns of a transcript with '\\n\\nHuman: ' and '\\n\\nAssistant: ' marks."""
    mark = r"\n\n(Human|Assistant): "
    roles = F.regexp_extract_all(text, F.lit(mark), F.lit(1))
    contents = F.slice(F.split(text, mark), 2, F.greatest(F.size(roles), F.lit(1)))
    return F.zip_with(roles, contents, lambda r, c: turn(F.when(r == "Human", "user").otherwise("assistant"), F.trim(c)))


def image_token_turns(conversation: Column, token: str = "<image>", start: str = "<im_start>", end: str = "<im_end>") -> Column:
    """The image token of answering turns between its marks."""
    wrapped = f"{start}{token}{end}"
    return F.transform(conversation, lambda x: F.struct(x["from"].alias("from"), F.when(x["from"] == "gpt", F.replace(x["value"], F.lit(token), F.lit(wrapped))).otherwise(x["value"]).alias("value")))


def without_nulls(fields: Column) -> Column:
    """A map without the entries whose value is null."""
    return F.map_filter(fields, lambda k, v: v.isNotNull())


def json_pick(json_array: Column, element: str, key: Column, seed: int = 42) -> Column:
    """One element of a JSON array, by a hash of the row's key; null for an empty or broken one."""
    items = F.from_json(json_array, f"array<{element}>")
    return F.when(F.size(items) > 0, F.get(items, F.pmod(F.xxhash64(key, F.lit(seed)), F.size(items)).cast("int")))
