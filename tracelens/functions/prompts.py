"""Prompts, messages and chat rendering."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import first_alias

#: Fixed texts of the verification task.
VERIFY = "Please verify the candidate solution step by step. End with: Verification: Is the answer correct (Yes/No)? X"
VERDICT_LINE = "Verification: Is the answer correct (Yes/No)? "
DEFAULT_SYSTEM = "You are Qwen, created by Alibaba Cloud. You are a helpful assistant."
SFT_HEAD = "You are a generative verifier for mathematical reasoning.\n\n"
SFT_TASK = (
    "Task: Decide whether the candidate reasoning and final answer are correct.\n"
    "Return ONLY one line. Do not explain. Do not write reasoning.\n"
    "Use exactly one of the following two outputs:\n"
    "<final_verdict>Yes</final_verdict>\n"
    "<final_verdict>No</final_verdict>"
)
#: Fixed texts of the tool list of a chat.
TOOLS_HEAD = "\n\n# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>"
TOOLS_TAIL = (
    "\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n"
    '<tool_call>\n{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call><|im_end|>\n'
)
#: Fixed text: how the chat form of a clean teacher row ends.
CHAT_TASK = "Please verify the candidate solution step by step and end with:\nVerification: Is the answer correct (Yes/No)? X"
#: Fixed alias lists: prompt field, columns that may hold it, default.
FIELDS = {
    "question": (["question", "problem", "prompt"], ""),
    "candidate_role": (["candidate_role", "role"], "unknown"),
    "candidate_solution": (["candidate_solution_clean", "candidate_solution", "generated_solution_clean", "generated_solution", "solution", "response"], ""),
    "reference_solution": (["reference_solution_clean", "reference_solution", "correct_solution_clean", "correct_solution", "reference_answer"], ""),
    "expected_answer": (["expected_answer", "answer", "gold_answer", "final_answer"], ""),
    "candidate_predicted_answer": (["candidate_predicted_answer", "predicted_answer"], ""),
}


def message(role: str | Column, content: Column) -> Column:
    return F.struct((role if isinstance(role, Column) else F.lit(role)).alias("role"), content.alias("content"))


def verify_request(question: Column, candidate: Column, task: str = VERIFY) -> Column:
    """[P23] The user's text of a verification task."""
    return F.concat(F.lit("Question:\n"), F.coalesce(question, F.lit("")), F.lit("\n\nCandidate Solution:\n"), F.coalesce(candidate, F.lit("")), F.lit(f"\n\n{task}"))


def verify_messages(question: Column, candidate: Column, rationale: Column, verdict: Column, given: Column | None = None, task: str = VERIFY) -> Column:
    """[P22] User and assistant message; the verdict line is added where the rationale lacks it. `given` messages of two or more pass through."""
    r = F.coalesce(rationale, F.lit(""))
    lacks = (F.coalesce(verdict, F.lit("")) != "") & ~r.contains("Verification: Is the answer correct")
    answer = F.when(lacks, F.concat(F.regexp_replace(r, r"(?U)[\s\x1c-\x1f]+$", ""), F.lit("\n" + VERDICT_LINE), verdict)).otherwise(r)
    made = F.array(message("user", verify_request(question, candidate, task)), message("assistant", answer))
    return made if given is None else F.when(F.size(given) >= 2, given).otherwise(made)


def chat(messages: Column, generate: bool = False, tools: Column | None = None, calls: bool = False) -> Column:
    """[P24 W16] A chat as im_start/im_end text. Messages are structs of role, content and, with `calls`, tool_calls
    (array<struct<name, arguments>>, arguments as JSON text); adjacent tool messages share one user turn; `tools` is an array of JSON texts."""
    system = F.when(messages[0]["role"] == "system", messages[0]["content"]).otherwise(F.lit(DEFAULT_SYSTEM))
    head = F.concat(F.lit("<|im_start|>system\n"), system, F.lit("<|im_end|>\n"))
    if tools is not None:
        names = F.array_join(F.transform(tools, lambda t: F.concat(F.lit("\n"), t)), "")
        listed = F.concat(F.lit("<|im_start|>system\n"), system, F.lit(TOOLS_HEAD), names, F.lit(TOOLS_TAIL))
        head = F.when(F.size(tools) > 0, listed).otherwise(head)

    def turn(m: Column, i: Column) -> Column:
        role, content = m["role"], F.coalesce(m["content"], F.lit(""))
        before = F.get(messages, i - 1)["role"]
        after = F.get(messages, i + 1)["role"]
        plain = F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), content, F.lit("<|im_end|>\n"))
        tool = F.concat(
            F.when((i == 0) | ~before.eqNullSafe(F.lit("tool")), "<|im_start|>user").otherwise(""), F.lit("\n<tool_response>\n"), content, F.lit("\n</tool_response>"),
            F.when(~after.eqNullSafe(F.lit("tool")), "<|im_end|>\n").otherwise(""),
        )
        out = F.when((role == "system") & (i == 0), "").when(role == "tool", tool)
        return out.when(role.isin("user", "system", "assistant"), plain).otherwise("")

    def with_calls(m: Column, i: Column) -> Column:
        calls = F.transform(m["tool_calls"], lambda c: F.concat(F.lit('\n<tool_call>\n{"name": "'), c["name"], F.lit('", "arguments": '), c["arguments"], F.lit("}\n</tool_call>")))
        content = F.coalesce(m["content"], F.lit(""))
        called = F.concat(F.lit("<|im_start|>assistant"), F.when(content != "", F.concat(F.lit("\n"), content)).otherwise(""), F.array_join(calls, ""), F.lit("<|im_end|>\n"))
        return F.when((m["role"] == "assistant") & (F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0), called).otherwise(turn(m, i))

    body = F.array_join(F.transform(messages, with_calls if calls else turn), "")
    return F.concat(head, body, F.lit("<|im_start|>assistant\n" if generate else ""))


def chat_rows(clean: DataFrame) -> DataFrame:
    """[D6, by its description] Clean teacher rows as chats: id, messages, and metadata of role and verdict."""
    m = verify_messages(F.col("question"), F.col("candidate_solution"), F.col("verification_rationale"), F.col("final_verdict"), task=CHAT_TASK)
    meta = F.create_map(F.lit("candidate_role"), F.col("candidate_role"), F.lit("final_verdict"), F.col("final_verdict"))
    return clean.select("id", m.alias("messages"), meta.alias("metadata"))


def plain_chat(user: Column) -> Column:
    """[P25]"""
    return F.concat(F.lit("### User:\n"), user, F.lit("\n\n### Assistant:\n"))


def fill(df: DataFrame, template: str, fields=FIELDS) -> Column:
    """[P26] A template whose {names} are filled from alias columns of `df`; an unknown name is an error. Values are never read as templates."""
    pieces = []
    for part in re.split(r"(\{\w+\})", template):
        name = part[1:-1] if re.fullmatch(r"\{\w+\}", part) else None
        if name is None:
            pieces.append(F.lit(part.replace("{{", "{").replace("}}", "}")))
        elif name in fields:
            pieces.append(first_alias(df, *fields[name]))
        else:
            raise KeyError(f"template field {name} is not one of {sorted(fields)}")
    return F.concat(*pieces)


def question_messages(question: Column, system: str, template: str = "{question}") -> Column:
    """[P27] System and user message of a direct or step-by-step prompt."""
    before, _, after = template.partition("{question}")
    return F.array(message("system", F.lit(system)), message("user", F.concat(F.lit(before), question, F.lit(after))))


def sft_example(question: Column, clean: Column, raw: Column, predicted: Column, correct: Column) -> Column:
    """[P28] struct<prompt, completion, label> with at most 3000 characters of the solution; a null answer reads None, as does a null question."""
    solution = F.substring(F.coalesce(F.nullif(clean, F.lit("")), F.nullif(raw, F.lit("")), F.lit("")), 1, 3000)
    none = lambda c: F.coalesce(c, F.lit("None"))
    prompt = F.concat(F.lit(SFT_HEAD + "Question:\n"), none(question), F.lit("\n\nCandidate reasoning:\n"), solution, F.lit("\n\nCandidate final answer: "), none(predicted), F.lit("\n\n" + SFT_TASK))
    label = F.when(F.coalesce(correct, F.lit(False)), "Yes").otherwise("No")
    return F.struct(prompt.alias("prompt"), F.concat(F.lit("<final_verdict>"), label, F.lit("</final_verdict>")).alias("completion"), label.alias("label"))


__all__ = ["chat", "chat_rows", "fill", "message", "plain_chat", "question_messages", "sft_example", "verify_messages", "verify_request"]
