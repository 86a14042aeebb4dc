"""Reviews by a language model: prompts as a table, answers cached, verdicts that fail open."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.text import prompt_hash, rescued_json
from codestrata.operators import rules
from codestrata.operators.relational import fail_open
from codestrata.session import Scratch

PRIORITY = {"high": 0, "medium": 1, "low": 2}


def safe_json(text: str | None) -> dict | None:
    """The first JSON object in a reply: fenced, else the first balanced braces that parse, else from the first brace to the last."""
    if not text:
        return None
    found = re.findall(r"```(?:json)?\s*(\{.*?\})\s*```", text, re.DOTALL)
    start = text.find("{")
    while start >= 0:
        depth, quoted, i = 0, False, start
        while i < len(text):
            c = text[i]
            if quoted:
                i += c == "\\"  # and what it escapes
                quoted = c != '"'
            elif c == '"':
                quoted = True
            else:
                depth += (c == "{") - (c == "}")
                if depth == 0:
                    found.append(text[start : i + 1])
                    break
            i += 1
        start = text.find("{", start + 1) if len(found) < 50 else -1
    found.append(text[text.find("{") : text.rfind("}") + 1])
    for f in found:
        try:
            out = json.loads(f)
        except ValueError:
            continue
        if isinstance(out, dict):
            return out
    return None


def ask(prompts: DataFrame, make_client: Callable, cache: DataFrame, model: str, keep: list[str]) -> DataFrame:
    """(keep..., prompt_hash, response, fresh, answered_by) for prompts (keep..., system, prompt).

    Cached answers are joined; only the rest is sent, in as many streams as there are
    partitions, each with a client of its own. An answer that fails is null.
    """
    hashed = prompts.withColumn("prompt_hash", prompt_hash(F.lit(model), F.col("system"), F.col("prompt")))
    known = cache.filter(F.col("model") == model).select("prompt_hash", "response")
    hits = hashed.join(known, "prompt_hash").select(*keep, "prompt_hash", "response", F.lit(False).alias("fresh"), F.lit(model).alias("answered_by"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for b in batches:
            answers = [answer_of(client, p, s, model) for p, s in zip(b["prompt"], b["system"])]
            text, by = (pd.Series([a[i] for a in answers], dtype=object, index=b.index) for i in (0, 1))
            yield b[[*keep, "prompt_hash"]].assign(response=text, fresh=True, answered_by=by)

    misses = hashed.join(known, "prompt_hash", "left_anti")
    kinds = {f.name: f.dataType.simpleString() for f in hashed.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keep, "prompt_hash"]) + ", response string, fresh boolean, answered_by string"
    return hits.unionByName(misses.select(*keep, "system", "prompt", "prompt_hash").mapInPandas(run, schema))


def answer_of(client, prompt: str, system: str, model: str) -> tuple[str | None, str | None]:
    """The answer and the model that gave it; a client that cannot say which has only the one that is asked."""
    if hasattr(client, "answer"):
        return client.answer(prompt, system)
    text = client.generate(prompt, system)
    return text, model if text is not None else None


def to_cache(answers: DataFrame, model: str) -> DataFrame:
    """Rows for the cache from fresh answers that the asked model gave itself; another one's answer is not kept as its."""
    return answers.filter("fresh AND response IS NOT NULL").filter(F.col("answered_by") == model).select("prompt_hash", F.lit(model).alias("model"), "response").dropDuplicates(["prompt_hash"])


def ask_kept(prompts: DataFrame, make_client: Callable, store, model: str, keep: list[str], workers: int = 6, each: int = 4, on_batch: Callable | None = None) -> int:
    """Ask in batches of about `workers` times `each` prompts, with `workers` streams at most; returns how many were answered.

    Each batch is written, its answers go to the store's cache, and `on_batch` gets its
    rows (keep..., response), all before the next one is sent. So a run that breaks off
    loses one batch at most, and the next run sends only what has no answer yet. The
    table of prompts is written once; a prompt's batch follows from its hash.
    """
    spark = prompts.sparkSession
    scratch = Scratch(spark, "prompts")
    hashed = prompts.withColumn("prompt_hash", prompt_hash(F.lit(model), F.col("system"), F.col("prompt")))
    work = scratch.write(hashed)
    known = store.table("llm_cache").filter(F.col("model") == model).select("prompt_hash")
    todo = work.join(known, "prompt_hash", "left_anti").select("prompt_hash").distinct().count()
    batches, answered = max(1, -(-todo // (workers * each))), 0
    for k in range(batches):
        batch = work.filter(F.pmod(F.xxhash64("prompt_hash"), F.lit(batches)) == k)
        once = batch.dropDuplicates(["prompt_hash"]).select("prompt_hash", "system", "prompt").repartition(workers, "prompt_hash")
        answers = scratch.write(ask(once.withColumnRenamed("prompt_hash", "key"), make_client, store.table("llm_cache"), model, ["key"]).coalesce(workers))
        fresh = to_cache(answers, model)
        if not fresh.isEmpty():
            store.put("llm_cache", fresh)
        rows = batch.select(*keep, F.col("prompt_hash").alias("key")).join(answers.filter("response IS NOT NULL").select("key", "response"), "key").select(*keep, "response").collect()
        answered += len(rows)
        if rows and on_batch:
            on_batch(rows)
    return answered


def verify(findings: DataFrame, make_client: Callable, cache: DataFrame, model: str) -> DataFrame:
    """Findings but those that the model denies as `{"is_real": false}`; no answer, or none that parses, keeps a finding."""
    keyed = findings.withColumn("key", F.sha2(F.concat_ws("|", "rule_id", "title", "detail"), 256))
    text = F.concat(F.lit("Is this finding real? Reply with JSON {\"is_real\": true or false}.\n"), "title", F.lit("\n"), "detail", F.lit("\n"), F.array_join("evidence", "\n"))
    answers = ask(keyed.select("key", F.lit("").alias("system"), text.alias("prompt")).dropDuplicates(["key"]), make_client, cache, model, ["key"])
    verdict = answers.select("key", F.from_json(rescued_json(F.col("response")), "is_real BOOLEAN")["is_real"].alias("is_real"))
    return fail_open(keyed, verdict, ["key"]).drop("key")


def module_prompts(nodes: DataFrame, edges: DataFrame, findings: DataFrame) -> DataFrame:
    """(module, system, prompt): what the audit knows of each module."""
    per = findings.select(F.explode("modules").alias("id"), F.concat("severity", F.lit(": "), "title").alias("f")).groupBy("id").agg(F.array_sort(F.collect_set("f")).alias("findings"))
    line = F.concat("src", F.lit(" -> "), "dst", F.lit(" ("), F.col("weight").cast("string"), F.lit(")"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"), line.alias("e")).groupBy("id").agg(F.slice(F.array_sort(F.collect_set("e")), 1, 12).alias("links"))
    full = nodes.join(per, "id", "left").join(ends, "id", "left")
    texts = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), "\n")
    prompt = F.concat(F.lit("Review module "), "id", F.lit("\nMembers:\n"), texts(F.col("members")), F.lit("\nDependencies:\n"), texts(F.col("links")), F.lit("\nFindings:\n"), texts(F.col("findings")), F.lit('\nReply with JSON {"assessment": text, "priority": "high", "medium" or "low", "recommendation": text}.'))
    return full.select(F.col("id").alias("module"), F.lit("You review the architecture of C++ code.").alias("system"), prompt.alias("prompt"))


def pending(prompts: DataFrame, done: DataFrame, graph_hash: str, key: str) -> DataFrame:
    """Prompts whose key has no parsed review of the current graph; a review without a hash counts as current."""
    current = done.filter(F.col("parsed_json").isNotNull() & (F.col("graph_hash").isNull() | (F.col("graph_hash") == graph_hash)))
    return prompts.join(current.select(F.col("module_name").alias(key)).distinct(), key, "left_anti")


def synthesis_rank(nodes: DataFrame) -> list[Column]:
    """God modules first, then those in cycles, then the rest, each by in-degree."""
    return [F.when(F.col("is_god"), 0).when(F.col("in_cycle"), 1).otherwise(2), F.desc("in_degree"), F.col("id")]


def synthesize(client, reviews: list[tuple[str, str]]) -> str | None:
    """One conclusion, grown module by module: the order matters, so this is a loop. A failed step keeps what is there."""
    conclusion = None
    for module, review in reviews:
        text = f"Conclusion so far:\n{conclusion or '(none)'}\n\nReview of {module}:\n{review}\n\nWrite the conclusion anew, with this taken in."
        conclusion = client.generate(text, "You summarise the architecture of C++ code.") or conclusion
    return conclusion


def compile_rules(client, prose: str) -> list[rules.Rule]:
    """Rules from prose; kinds that no checker knows are dropped. Nothing where there is no answer."""
    reply = safe_json(client.generate(f"Turn these rules into JSON {{\"rules\": [{{\"id\", \"kind\", \"params\"}}]}}; kinds: {', '.join(sorted(rules.CHECKERS))}.\n\n{prose}"))
    out = []
    for i, r in enumerate((reply or {}).get("rules") or []):
        if isinstance(r, dict) and r.get("kind") in rules.CHECKERS:
            out.append(rules.Rule(str(r.get("id") or f"R{i + 1}"), r["kind"], r.get("params") if isinstance(r.get("params"), dict) else {}))
    return out


def by_priority(recommendations: list[dict]) -> list[dict]:
    """high, medium, low, then the rest; otherwise as given."""
    return sorted(recommendations, key=lambda r: PRIORITY.get(str(r.get("priority", "")).lower(), 3))
