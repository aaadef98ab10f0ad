"""Seams for text models and embedders, with deterministic offline defaults.

A provider runs on the executors, in Arrow batches. Prompts begin with a line that names the task; the offline model
answers each task by rules.
"""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import vector
from .permits import lender


class TransientError(Exception):
    """A failure that may pass: it is tried again."""


class Answer(str):
    """A response with the numbers of tokens that its call was billed for. Plain strings are counted by white space."""

    prompt_tokens: int
    completion_tokens: int

    def __new__(cls, text: str, prompt_tokens: int, completion_tokens: int) -> Answer:
        self = super().__new__(cls, text)
        self.prompt_tokens, self.completion_tokens = prompt_tokens, completion_tokens
        return self


def used(prompt: str | None, answer: str | None) -> tuple[int | None, int | None]:
    """Tokens in and out of one call; null if it gave no answer."""
    if answer is None:
        return None, None
    if isinstance(answer, Answer):
        return answer.prompt_tokens, answer.completion_tokens
    return len((prompt or "").split()), len(answer.split())


class CompletionProvider(Protocol):
    """A text model. ``complete_yes_no`` and ``complete_json`` may be left out: ``complete`` is asked then.

    Responses may be ``Answer`` objects, which carry their tokens. A provider with an attribute ``model`` has its calls
    priced by that name.
    """

    def complete(self, prompts: list[str]) -> list[str]: ...


class Embedder(Protocol):
    def embedded(self, rows: DataFrame, text: str, name: str) -> DataFrame: ...


#: What each task asks for; a provider for a real model sends these words, the offline one goes by the task's name.
PROMPTS = {
    "extract": 'List all entities of the text as ("entity"<|>name<|>type<|>description), then how they are related as ("relationship"<|>source<|>target<|>description<|>strength from 1 to 10), then what is said of them as ("claim"<|>subject<|>type<|>description<|>status<|>start<|>end). Put ## between records and <|COMPLETE|> at the end.',
    "more": "Has the text entities that a first reading is likely to miss? Answer YES or NO only.",
    "continue": "List only those entities and relationships of the text that a first reading is likely to miss, in the same format.",
    "report": "Write a report on this group of entities as a JSON object: title, summary, rating from 0 to 10, rating_explanation, and findings, each with a summary and an explanation.",
    "points": "Which points of this report help to answer the question? Give a JSON object with a list points, each with a description and a score from 0 to 100.",
    "answer": "Answer the question from the context alone.",
    "judge": "Which of the answers a and b is better by this criterion? Give a JSON object: winner (A, B or TIE), score_a and score_b from 0 to 100, reasoning.",
    "claims": "List what the answer claims as a JSON object with a list claims of full sentences.",
}
#: How an answer is asked for: as it comes, as a single YES or NO, or as a JSON object.
TEXT, YES_NO, JSON = "text", "yes_no", "json"
MODES = {"more": YES_NO, "report": JSON, "points": JSON, "judge": JSON, "claims": JSON}


def task(name: str, **fields: Column | str) -> Column:
    """A prompt: the task's name, what it asks for, then each field under its own name."""
    parts = [F.lit(f"TASK: {name}\n{PROMPTS.get(name, '')}")]
    for k, v in fields.items():
        parts += [F.lit(f"\n### {k}\n"), F.col(v) if isinstance(v, str) else v]
    return F.concat(*parts)


def messages(prompt: str, system: str | None = None, history: list[tuple[str, str]] = ()) -> list[dict[str, str]]:
    """A prompt as a chat API takes it: a system turn if there is one, earlier (role, text) turns, and the user's."""
    turns = ([("system", system)] if system else []) + list(history) + [("user", prompt)]
    return [{"role": role, "content": text} for role, text in turns]


def _field(prompt: str, name: str) -> str:
    m = re.search(rf"(?s)\n### {name}\n(.*?)(?=\n### |\Z)", prompt)
    return m[1] if m else ""


class RuleModel:
    """Answers by rules: capitalised words are entities, neighbours are related, sentences are points and claims."""

    def complete(self, prompts: list[str]) -> list[str]:
        return [getattr(self, "_" + p.split("\n", 1)[0].removeprefix("TASK: ").strip())(p) for p in prompts]

    def _extract(self, prompt: str) -> str:
        names = [w for w in re.findall(r"[^\W\d_]{4,}", _field(prompt, "text")) if w[0].isupper() and w[1:].islower()]
        kinds = ("ORGANIZATION", "PERSON", "LOCATION", "CONCEPT")
        records = [f'("entity"<|>{n}<|>{kinds[len(n) % 4]}<|>mentioned as {n})' for n in dict.fromkeys(names)]
        records += [f'("relationship"<|>{a}<|>{b}<|>{a} stands before {b}<|>{1 + len(a) % 10})' for a, b in zip(names, names[1:])]
        return "##".join(records) + "<|COMPLETE|>"

    def _more(self, prompt: str) -> str:
        return "YES" if len(_field(prompt, "text")) % 2 else "NO"

    def _continue(self, prompt: str) -> str:
        names = [w for w in re.findall(r"[^\W\d_]+", _field(prompt, "text")) if w.isupper() and len(w) > 2]
        return "##".join(f'("entity"<|>{n}<|>CONCEPT<|>written as {n})' for n in dict.fromkeys(names)) + "<|COMPLETE|>"

    def _report(self, prompt: str) -> str:
        context = _field(prompt, "context")
        names = re.findall(r"Entity: (.*)", context)
        findings = [{"summary": line[:200], "explanation": ""} for line in re.findall(r"(?:Relationship|Summary): (.*)", context)[:5]]
        return json.dumps({"title": " and ".join(names[:2]) or "Report", "summary": f"{len(names)} entities", "rating": min(10, len(findings) * 2), "rating_explanation": "by the number of relationships", "findings": findings})

    def _points(self, prompt: str) -> str:
        asked = set(re.findall(r"\w+", _field(prompt, "question").lower()))
        lines = [x for x in _field(prompt, "context").split("\n") if x.strip()]
        points = [{"description": x[:300], "score": min(100, 10 * len(asked & set(re.findall(r"\w+", x.lower()))))} for x in lines]
        return json.dumps({"points": sorted(points, key=lambda p: -p["score"])[:5]})

    def _answer(self, prompt: str) -> str:
        return _field(prompt, "context")[:2000]

    def _judge(self, prompt: str) -> str:
        a, b = len(set(_field(prompt, "a").split())), len(set(_field(prompt, "b").split()))
        return json.dumps({"winner": "A" if a > b else "B" if b > a else "TIE", "score_a": min(100, a), "score_b": min(100, b), "reasoning": "by different words"})

    def _claims(self, prompt: str) -> str:
        return json.dumps({"claims": [s.strip() for s in re.split(r"[.\n]", _field(prompt, "answer")) if s.strip()]})


class HashedEmbedder:
    """Token counts by buckets, of unit length."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embedded(self, rows: DataFrame, text: str, name: str) -> DataFrame:
        toks = f"_{name}_tokens"
        rows = rows.withColumn(toks, tx.tokens(tx.cleaned(text)))
        return rows.withColumn(name, F.transform(vector.hashed(toks, self.dim), lambda x: x.cast("float"))).drop(toks)


def _yes_no(answer: str | None) -> str | None:
    return None if answer is None else "YES" if answer.strip().upper().startswith("Y") else "NO"


def completed(
    rows: DataFrame, prompt: str, provider: CompletionProvider, attempts: int = 3, wait: float = 0.5, mode: str = TEXT, most: int | None = None,
    answered: Accumulator | None = None, failed: Accumulator | None = None, usage: bool = False,
) -> DataFrame:
    """Adds response and error (at most 500 characters), and with ``usage`` prompt_tokens and completion_tokens.

    A batch that fails for a passing reason is tried again, with growing random waits; what fails for good leaves a null
    response. ``mode`` picks the provider's method for it, if it has one; with YES_NO the response is YES or NO in any
    case. At most ``most`` calls are under way at a time in all tasks of the application: each call holds one of as many
    permits, and waits are slept without one. Rows stay in their partitions. ``answered`` and ``failed`` count prompts as
    tasks end; a task that runs again counts again. Tokens are those of the call that answered; a prompt without a response
    has none.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", response string, error string"
    schema += ", prompt_tokens long, completion_tokens long" * usage
    method = getattr(provider, f"complete_{mode}", provider.complete) if mode != TEXT else provider.complete
    permits = lender(rows.sparkSession, type(provider).__name__, most).permits if most else None

    def call(batch: list[str]) -> list[str]:
        if permits is None:
            return list(method(batch))
        with permits.one():
            return list(method(batch))

    def ask(batch: list[str]) -> tuple[list[str | None], list[str | None]]:
        for k in range(attempts):
            try:
                return call(batch), [None] * len(batch)
            except TransientError as e:
                last = e
                if k + 1 < attempts:
                    time.sleep(random.uniform(0, wait * 2**k))
            except Exception as e:  # noqa: BLE001
                last = e
                break
        if len(batch) > 1:
            each = [ask([p]) for p in batch]
            return [r for x, _ in each for r in x], [e for _, x in each for e in x]
        return [None], [str(last)[:500]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got, errors = ask(batch[prompt].tolist()) if len(batch) else ([], [])
            if answered is not None:
                answered.add(sum(e is None for e in errors))
            if failed is not None:
                failed.add(sum(e is not None for e in errors))
            tokens = list(map(used, batch[prompt], got)) if usage else []
            got = [_yes_no(x) if mode == YES_NO else None if x is None else str(x) for x in got]
            batch = batch.assign(response=pd.Series(got, index=batch.index, dtype=object), error=pd.Series(errors, index=batch.index, dtype=object))
            if usage:
                counts = {name: pd.Series([t[k] for t in tokens], index=batch.index, dtype="Int64") for k, name in enumerate(("prompt_tokens", "completion_tokens"))}
                batch = batch.assign(**counts)
            yield batch

    return rows.mapInPandas(run, schema)
