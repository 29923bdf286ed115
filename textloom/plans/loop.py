"""The loop over a store: tickets, taxonomy, labels, findings, review, second version, scores, documents."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import agreement, evaluate, export, generate, improve, induction, labeling, ledger, model, quality, review, similarity, taxonomy
from textloom.operators.export import SEED
from textloom.operators.generate import COUNTS
from textloom.operators.ranking import global_rank
from textloom.plans import report as documents
from textloom.sources import config
from textloom.sources.store import Store

STAGES = ("generate", "induce", "label", "qa", "review", "improve", "evaluate", "report", "export")
LABELS = "run_id string, doc_id long, label string, confidence double, rationale string, abstain boolean, source string"
LOG = "doc_id long, ordinal long, decision string, final_label string, covered array<string>, seconds double"
#: A domain of few classes needs fewer leaves than an induced taxonomy.
N_LEAVES = (2, 14)
Annotator = Callable[[DataFrame], DataFrame]


class Loop:
    """One store and its settings; every stage records its run and gives 0, or 1 if it failed."""

    def __init__(self, store: Store, settings: model.Settings | None = None):
        self.store, self.settings = store, settings or model.Settings.read()
        store.schemas |= {"labels": LABELS, "log": LOG, "flags": "doc_id long, flag_type string, rank int, detail string, routed boolean", "queue": "doc_id long, reason string, rank int, place int"}

    def _run(self, stage: str, work: Callable[[str], str | None]) -> int:
        run_id = self.store.start(stage, self.settings.model)
        try:
            note = work(run_id)
        except Exception as e:
            self.store.finish(run_id, "failed", f"{type(e).__name__}: {e}")
            raise
        self.store.finish(run_id, "failed" if note and note.startswith("failed") else "ok", note)
        return int(bool(note and note.startswith("failed")))

    def generate(self, n: int = 600, seed: int = SEED, counts: dict[str, int] = COUNTS) -> int:
        """Tickets without what is planted, and what is planted in a table of its own, which only evaluate() reads."""

        def work(_: str) -> str | None:
            rows = generate.tickets(self.store.spark, n, seed, counts)
            self.store.replace("tickets", rows.select("doc_id", "subject", "body", "channel", "tier", "created_at", "vendor"))
            self.store.replace("truth", rows.select("doc_id", "subject", "truth", "alternate", "kind", "spans", "pair", "vendor"))
            bad = [r["name"] for r in generate.checks(rows, n, counts, seed).where("NOT ok").collect()]
            return f"failed: {', '.join(bad)}" if bad else f"{n} tickets of seed {seed}"

        return self._run("generate", work)

    def induce(self, path: str, alignment: dict[str, list[str]], relock: bool = False) -> int:
        """Checks the taxonomy of a file and locks it; a file that is locked already must not have changed unless `relock`."""

        def work(_: str) -> str | None:
            locks = json.loads(self.store.meta("locks") or "{}")
            if path in locks and not relock:
                config.check_lock(path, locks)
            tree = config.loads(Path(path).read_text()) if not path.endswith(".json") else json.loads(Path(path).read_text())
            rows = [(i, d["name"], x["name"], x.get("definition"), len(x["inclusion_criteria"]), len(x["exclusion_criteria"]), len(x["boundary_examples"])) for i, d in enumerate(tree["domains"]) for x in d["leaves"]]
            found = taxonomy.problems(self.store.spark.createDataFrame(rows, "domain_no int, domain string, name string, definition string, n_inclusion int, n_exclusion int, n_examples int"), n_leaves=N_LEAVES)
            if problems := [f"{r['subject']}: {r['problem']}" for r in found.orderBy("subject", "problem").collect()]:
                self.store.set_meta("induction", induction.failure(tree, problems))
                return f"failed: {'; '.join(problems)}"
            self.store.set_meta("taxonomy", json.dumps(tree))
            self.store.set_meta("alignment", json.dumps(alignment))
            self.store.set_meta("locks", json.dumps(config.lock(path, locks)))
            return f"{len(rows)} leaves locked"

        return self._run("induce", work)

    def _taxonomy(self) -> tuple[dict, list[dict], list[str]]:
        for path, digest in json.loads(self.store.meta("locks") or "{}").items():
            config.check_lock(path, {path: digest})
        if not (text := self.store.meta("taxonomy")):
            raise config.Drift("no taxonomy is locked")
        leaves = [x for d in json.loads(text)["domains"] for x in d["leaves"]]
        return json.loads(text), leaves, sorted(x["name"] for x in leaves)

    def label(self, annotate: Annotator | None = None) -> int:
        """Labels of both annotators. `annotate` takes tickets to doc_id, label, confidence, rationale, abstain; without it,
        the first annotator is the deterministic one on bodies alone."""

        def work(run_id: str) -> str | None:
            _, leaves, names = self._taxonomy()
            weights = labeling.leaf_terms(leaves)
            tickets = self.store.read("tickets")
            by_body = lambda rows: labeling.label(rows.withColumn("subject", F.lit("")), weights, names).select("doc_id", "label", (0.5 + F.col("margin") / 2).alias("confidence"), F.lit("by body").alias("rationale"), (F.col("score") <= 0).alias("abstain"))
            first = labeling.clean((annotate or by_body)(tickets), names).select("doc_id", "label", "confidence", "rationale", "abstain")
            first = labeling.fill_missing(tickets, first.drop("rationale")).join(first.select("doc_id", "rationale"), "doc_id", "left")
            second = labeling.label(tickets, weights, names).select("doc_id", "label", F.col("margin").alias("confidence"), F.lit("by terms").alias("rationale"), F.lit(False).alias("abstain"))
            for source, rows in (("a", first), ("b", second)):
                self.store.write_labels(rows.select(F.lit(run_id).alias("run_id"), "doc_id", "label", "confidence", "rationale", "abstain", F.lit(source).alias("source")))
            return None

        return self._run("label", work)

    def views(self) -> DataFrame:
        """doc_id, vendor, leaves, and the newest labels of both annotators."""
        alignment = json.loads(self.store.meta("alignment") or "{}")
        rows = self.store.read("tickets").select("doc_id", "vendor", labeling.leaves_of(alignment, F.col("vendor")).alias("leaves") if alignment else F.array().cast("array<string>").alias("leaves"))
        a = self.store.latest_labels("a").select("doc_id", F.col("label").alias("a_label"), F.col("confidence").alias("a_conf"), F.col("abstain").alias("a_abstain"))
        b = self.store.latest_labels("b").select("doc_id", F.col("label").alias("b_label"))
        return rows.join(a, "doc_id", "left").join(b, "doc_id", "left").withColumn("a_abstain", F.coalesce("a_abstain", F.lit(True)))

    def texts(self) -> DataFrame:
        return self.store.read("tickets").select("doc_id", F.concat_ws(" ", "subject", "body").alias("text"))

    def qa(self) -> int:
        """Findings of all kinds, and the queue of what people have to look at."""

        def work(_: str) -> str | None:
            rows = self.views()
            reached = sorted({x for v in json.loads(self.store.meta("alignment") or "{}").values() for x in v})
            suspected, granularity = quality.split_by_reach(quality.suspected(rows), reached)
            ambiguous = global_rank(quality.ambiguous(rows), [F.asc("doc_id")], "rank")
            docs = self.texts()
            members = similarity.classes(docs)
            clusters = self.store.replace("clusters", similarity.document_clusters(similarity.near_duplicates(docs, members=members), members))
            places = global_rank(clusters.select("component").distinct(), [F.asc("component")], "rank")
            spans = self.store.read("tickets").select("doc_id", T.pii_spans(F.col("body")).alias("spans")).where(F.size("spans") > 0)
            contested = quality.contested(clusters.join(rows.select("doc_id", F.col("a_label").alias("label"), "leaves"), "doc_id")).select(F.col("component").alias("doc_id"))
            routed = quality.route((suspected, "suspected_label_error"), (ambiguous, "ambiguity"), (contested, "duplicate"))
            routed = self.store.replace("routed", routed)
            self.store.replace("flags", quality.flags({
                "taxonomy_granularity": quality.detailed(granularity, "vendor_leaves", "proposed", "confidence", "route"), "suspected_label_error": quality.detailed(suspected, "vendor_leaves", "proposed", "confidence", "route"),
                "duplicate": quality.detailed(clusters.join(places, "component"), "component"), "pii": quality.detailed(spans, "spans"), "ambiguity": quality.detailed(ambiguous, "reasons")}, routed))
            self.store.replace("queue", quality.queue(routed, suspected.select("doc_id", "rank")))
            return f"{routed.count()} routed"

        return self._run("qa", work)

    def review(self, answers: DataFrame) -> int:
        """Adds decisions (doc_id, decision, leaf, seconds) to the log, in the order of doc_id behind those that are there."""

        def work(_: str) -> str | None:
            before = self.store.read("log").agg(F.coalesce(F.max("ordinal"), F.lit(0)).alias("n")).first()["n"]
            numbered = global_rank(answers, [F.asc("doc_id"), F.asc("decision")], "ordinal").withColumn("ordinal", F.col("ordinal").cast("long") + before)
            views = self.views()
            log = review.adjudicate(numbered, views).join(views.select("doc_id", F.col("leaves").alias("covered")), "doc_id").select("doc_id", "ordinal", "decision", "final_label", F.when(F.col("decision") == "accept_vendor", F.col("covered")).alias("covered"), "seconds")
            self.store.upsert("log", log, ["doc_id", "ordinal"])
            return None

        return self._run("review", work)

    def screens(self) -> DataFrame:
        """What is left to review, as a reviewer sees it."""
        labels = self.store.latest_labels("a").unionByName(self.store.latest_labels("b"))
        return review.screens(review.pending(self.store.read("queue"), self.store.read("log")), self.store.read("tickets"), labels, self.store.read("flags"))

    def improve(self) -> int:
        def work(_: str) -> str | None:
            rows = self.views()
            log = improve.latest_adjudications(self.store.read("log")).select("doc_id", "decision", "final_label", "covered")
            docs = self.store.read("tickets").select("doc_id", F.col("body").alias("text"))
            v2 = self.store.replace("dataset_v2", improve.second_version(docs, improve.first_version(rows), log, rows.select("doc_id", F.col("b_label").alias("other")), self.store.read("clusters")))
            self.store.replace("diff", improve.difference(v2))
            return None

        return self._run("improve", work)

    def measure(self) -> dict:
        """What evaluate() and the documents show, read from the tables."""
        truth, rows, v2 = self.store.read("truth"), self.views(), self.store.read("dataset_v2")
        one = lambda df: df.first().asDict()
        both = rows.join(truth.drop("vendor"), "doc_id").join(v2.select("doc_id", "before", F.col("label").alias("after"), "alt_label", "status", F.col("body").alias("new_body")), "doc_id")
        right = lambda c: (F.col(c) == F.col("truth")) | F.coalesce(F.col(c) == F.col("alternate"), F.lit(False))
        left = both.where("status <> 'merged_duplicate'")
        parts = [evaluate.accuracy(both, "v1", right("before")), evaluate.accuracy(left, "v2", right("after") | F.coalesce(right("alt_label"), F.lit(False))), evaluate.accuracy(both, "second annotator", right("b_label")), evaluate.accuracy(both, "vendor", right("vendor"))]
        scores = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
        flags = self.store.read("flags")
        doubted = flags.where(F.col("flag_type").isin("suspected_label_error", "taxonomy_granularity")).select("doc_id", F.lit(True).alias("f")).distinct()
        personal = flags.where("flag_type = 'pii'").select("doc_id", F.lit(True).alias("p")).distinct()
        both = both.join(doubted, "doc_id", "left").join(personal, "doc_id", "left")
        kind = F.coalesce("kind", F.lit(""))
        classes = sorted({r["truth"] for r in truth.select("truth").distinct().collect()})  # as many as there are classes
        log = self.store.read("log")
        median = ledger.upper_median(log.withColumn("all", F.lit(1)), ["all"], "seconds").first()
        pairs = truth.where("pair IS NOT NULL").select(F.col("pair").alias("pair_id"), "doc_id")
        duplicates = one(evaluate.cluster_scores(pairs, self.store.read("clusters"), truth.select("doc_id", F.col("subject").alias("shape"))))
        costs = ledger.by_stage(self.store.read("costs"), self.store.runs().select("run_id", "stage"))
        accuracies = {r["name"]: r["value"] for r in scores.collect()}
        delta = evaluate.delta_points(scores).first()["delta_points"]
        seeded = one(evaluate.seeded_errors(both, kind == "error", F.coalesce("f", F.lit(False)), F.coalesce(right("after"), F.lit(False))))
        leaks = both.where(T.has_pii(F.col("new_body"))).count()
        metrics = [("delta_points", delta), ("seeded_recall", seeded["recall"]), ("leaks", float(leaks)), ("duplicate_recall", duplicates["recall"]), ("cost_usd", self.store.spent())]
        gates = evaluate.gates(self.store.spark.createDataFrame(metrics, "name string, value double"))
        return {
            "accuracy": accuracies, "delta_points": delta, "seeded": seeded, "duplicates": duplicates, "pii": one(evaluate.recall_precision(both, kind == "pii", F.coalesce("p", F.lit(False)))), "leaks": leaks,
            "routed": self.store.read("routed").count(), "total": rows.count(), "flags": [(r["flag_type"], r["n"]) for r in flags.groupBy("flag_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "flag_type").collect()],
            "decisions": [(r["decision"], r["n"], r["seconds"]) for r in ledger.decisions(log).orderBy(F.desc("n"), "decision").collect()], "median_seconds": median["upper_median"] if median else None,
            "abstention": one(evaluate.abstention(both, kind == "ambiguous", right("b_label"))), "unreachable": one(evaluate.unreachable(both, [c for c in classes if c not in self._taxonomy()[2]])),
            "agreement": [r.asDict() for r in agreement.kappas(rows, (("a_label", "b_label"),)).collect()], "costs": [tuple(r) for r in costs.orderBy("stage").collect()],
            "gates": [tuple(r) for r in gates.orderBy("name").collect()]}

    def evaluate(self) -> int:
        """Scores against what was planted; 1 if a gate fails."""

        def work(_: str) -> str | None:
            found = self.measure()
            self.store.set_meta("results", json.dumps(found, sort_keys=True))
            bad = [g[0] for g in found["gates"] if g[3] == "FAIL"]
            return f"failed: {', '.join(bad)}" if bad else None

        return self._run("evaluate", work)

    def report(self) -> int:
        if not (results := self.store.meta("results")):
            return 1
        return self._run("report", lambda _: self.store.set_meta("report", documents.report(json.loads(results))))

    def export(self, folder: str) -> int:
        """Both splits as JSON lines with the tickets' fields, and the datasheet; personal data in any of them stops it."""

        def work(_: str) -> str | None:
            v2, tickets = self.store.read("dataset_v2"), self.store.read("tickets")
            rows = export.split(export.usable(v2).select("doc_id", "label", "alt_label", "body"))
            export.write(export.records(rows, tickets), folder)
            tree, _, names = self._taxonomy()
            log = self.store.read("log")
            count = lambda df, c: [(r[c], r["n"]) for r in df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), c).collect()]
            times = log.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("s")).first()
            self.store.set_meta("datasheet", documents.datasheet({
                "title": "labeled tickets", "rows": tickets.count(), "exported": rows.count(), "splits": dict(count(rows, "split")), "leaves": names, "domains": len(tree["domains"]), "fields": export.FIELDS,
                "excluded": [(r["reason"], r["n"]) for r in export.exclusions(v2).orderBy(F.desc("n"), "reason").collect()], "labels": count(rows, "label"), "planted": dict(count(self.store.read("truth").where("kind IS NOT NULL"), "kind")),
                "routed": self.store.read("routed").count(), "reviewed": times["n"], "seconds": times["s"]}))
            return None

        return self._run("export", work)

    def status(self) -> str:
        """The last successful run of each stage, what is there, and what was spent of the cap."""
        latest = {r["stage"]: r for r in ledger.latest_runs(self.store.runs()).collect()}  # as many as there are stages
        done = review.progress(self.store.read("log")).first() if self.store.exists("log") else None
        tickets = self.store.read("tickets").count() if self.store.exists("tickets") else 0
        lines = [f"tickets: {tickets}"]
        locks = json.loads(self.store.meta("locks") or "{}")
        for path, digest in locks.items() or {"taxonomy": None}.items():
            try:
                config.check_lock(path, locks)
                lines.append(f"{path}: locked {digest[:12]}, intact")
            except config.Drift as e:
                lines.append(str(e))
        lines.append(f"decisions: {done['decisions'] if done else 0}")
        for stage in STAGES:
            run = latest.get(stage)
            lines.append(f"{stage}: " + (f"{run['run_id']} at {run['finished_at']}, {run['cost_usd']:.4f} USD" if run else "not run"))
        spent = self.store.spent()
        return "\n".join([*lines, f"spent: {spent:.4f} of {self.settings.cost_cap:.2f} USD ({documents.percent(spent / self.settings.cost_cap if self.settings.cost_cap else 0.0)})"])

    def run_all(self, path: str, alignment: dict[str, list[str]], n: int = 600, seed: int = SEED, annotate: Annotator | None = None) -> int:
        """Everything up to where people decide; stops at the first stage that fails."""
        for stage in (lambda: self.generate(n, seed), lambda: self.induce(path, alignment), lambda: self.label(annotate), self.qa):
            if code := stage():
                return code
        return 0
