"""Inducing a taxonomy: blind samples, prompts, the alignment of other labels with it, and the documents that are kept."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import taxonomy

BODY_CHARS = 420
#: Of a taxonomy, as the configuration files hold it.
TAXONOMY_ROW = "domains array<struct<name string, description string, leaves array<struct<name string, definition string, inclusion_criteria array<string>, exclusion_criteria array<string>, boundary_examples array<string>>>>>"
PARTS = (("Include when:", "inclusion_criteria"), ("Do not include when:", "exclusion_criteria"), ("Boundary cases:", "boundary_examples"))


def blind_sample(tickets: DataFrame, n: int, seed: int) -> DataFrame:
    """doc_id, subject and the start of the body of n tickets (doc_id, subject, body, ...) in seeded order; no label is read."""
    return taxonomy.sample(tickets.select("doc_id", "subject", F.substring("body", 1, BODY_CHARS).alias("body")), n, seed)


def ticket_block(doc_id: str = "doc_id", subject: str = "subject", body: str = "body") -> Column:
    """A ticket as a prompt shows it."""
    return F.concat(F.lit("["), F.col(doc_id).cast("string"), F.lit("]\nSubject: "), F.coalesce(F.col(subject), F.lit("")), F.lit("\n"), F.coalesce(F.col(body), F.lit("")))


def prompts(tickets: DataFrame, per_prompt: int) -> DataFrame:
    """batch and prompt: the blocks of `per_prompt` tickets (doc_id, subject, body, batch) each, in the order of doc_id."""
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", ticket_block().alias("block")))), lambda x: x["block"])
    return tickets.groupBy(F.floor((F.col("batch") - 1) / per_prompt).alias("batch")).agg(F.array_join(blocks, "\n\n").alias("prompt"))


def leaf_names(domains: str = "domains") -> Column:
    """All leaf names, domain by domain."""
    return F.flatten(F.transform(domains, lambda d: d["leaves"]["name"]))


def taxonomy_block(domains: str = "domains") -> Column:
    """A taxonomy (array of domains) as the text that prompts are grounded on."""

    def criteria(leaf: Column) -> Column:
        lists = [F.when(F.size(leaf[field]) > 0, F.concat(F.array(F.lit(title)), F.transform(leaf[field], lambda c: F.concat(F.lit("  - "), c)))).otherwise(F.array().cast("array<string>")) for title, field in PARTS]
        return F.concat(F.array(F.concat(F.lit("\n### "), leaf["name"]), leaf["definition"]), *lists)

    heads = lambda d: F.rtrim(F.concat(F.lit("## "), d["name"], F.lit(": "), F.coalesce(d["description"], F.lit(""))))
    lines = F.flatten(F.transform(domains, lambda d: F.concat(F.array(heads(d)), F.flatten(F.transform(d["leaves"], criteria)), F.array(F.lit("")))))
    return F.array_join(lines, "\n")


def cleaned(domains: str = "domains") -> Column:
    """A taxonomy whose prose, but no name, has commas for long dashes."""
    prose = lambda a: F.transform(a, T.plain_dashes)

    def leaf(x: Column) -> Column:
        return F.struct(x["name"].alias("name"), T.plain_dashes(x["definition"]).alias("definition"), *[prose(x[f]).alias(f) for _, f in PARTS])

    return F.transform(domains, lambda d: F.struct(d["name"].alias("name"), T.plain_dashes(d["description"]).alias("description"), F.transform(d["leaves"], leaf).alias("leaves")))


def alignment(vendors: DataFrame, mappings: DataFrame, leaves: list[str]) -> DataFrame:
    """vendor, leaves and reasoning for every vendor label: of a model's mappings (vendor, leaves, reasoning) the valid leaves,
    trimmed, in their order; of a label that is mapped twice the last (by ordinal); none for a label it left out."""
    valid = F.array(*map(F.lit, leaves))
    trimmed = F.transform("leaves", lambda x: F.trim(x))
    given = mappings.groupBy("vendor").agg(F.max_by(F.struct("leaves", "reasoning"), "ordinal").alias("m")).select("vendor", "m.*")
    kept = F.filter(trimmed, lambda x: F.array_contains(valid, x))
    found = given.select("vendor", kept.alias("leaves"), T.plain_dashes(F.coalesce("reasoning", F.lit(""))).alias("reasoning"))
    return vendors.select("vendor").distinct().join(found, "vendor", "left").select("vendor", F.coalesce("leaves", F.array().cast("array<string>")).alias("leaves"), F.coalesce("reasoning", F.lit("")).alias("reasoning"))


def assigned(assignments: DataFrame) -> DataFrame:
    """leaf and n, the most common first, then by name."""
    return assignments.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "leaf")


def rationale(tree: dict, coverage: dict, counts: list[tuple[str, int]], repairs: int) -> str:
    """The document that records why a taxonomy is as it is, and how well it covers the sample (a row of taxonomy.coverage)."""
    out = ["# Taxonomy rationale", "", (tree.get("rationale") or "").strip() or "_none returned_", "", "## Structure", ""]
    for domain in tree["domains"]:
        out += [f"### {domain['name']}", "", (domain.get("description") or "").strip(), ""] + [f"- **{x['name']}**: {x['definition']}" for x in domain["leaves"]] + [""]
    out += ["## Coverage", "", f"- sample: {coverage['n']}", f"- unmappable: {coverage['unmappable']} ({coverage['rate']:.1%}, at most {taxonomy.UNMAPPABLE:.0%})", f"- repairs: {repairs}", "", "| Leaf | Sampled |", "|---|---|"]
    return "\n".join([*out, *[f"| {leaf} | {n} |" for leaf, n in counts], ""])


def failure(tree: dict, problems: list[str], coverage: dict | None = None) -> str:
    """The document that is kept of a proposal with problems; nothing is locked then."""
    out = ["# Induction failed", "", f"{len(problems)} problems; the taxonomy is not locked.", "", *[f"- {p}" for p in problems]]
    if coverage is not None:
        out += ["", f"Unmappable: {coverage['rate']:.1%} of {coverage['n']} documents."]
    return "\n".join([*out, "", "## Proposal", "", "```json", json.dumps(tree, indent=2, ensure_ascii=False), "```", ""])
