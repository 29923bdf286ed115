"""The documents that a run leaves: a report of what was measured, and a datasheet of what is exported."""

from __future__ import annotations


def percent(x: float | None) -> str:
    return "not evaluable" if x is None else f"{100 * x:.1f}%"


def signed(x: float | None) -> str:
    return "not evaluable" if x is None else f"{x:+.1f}"


def table(head: list[str], rows: list[tuple]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *["| " + " | ".join(str(x) for x in r) + " |" for r in rows], ""]


def report(m: dict) -> str:
    """Markdown of measured values: accuracy {name: value}, delta_points, seeded, duplicates, pii, leaks, routed, total, flags,
    decisions [(decision, n, seconds)], median_seconds, abstention, unreachable, costs [(stage, calls, in, out, usd)], gates."""
    a, s, d, ab = m["accuracy"], m["seeded"], m["duplicates"], m["abstention"]
    seconds = sum(x[2] for x in m["decisions"])
    reviewed = sum(x[1] for x in m["decisions"])
    out = ["# Report", "", "Every number is read from the tables of the run.", "", "## Headline", ""]
    out += table(["Measure", "First version", "Second version"], [
        ("accuracy", percent(a.get("v1")), f"{percent(a.get('v2'))} ({signed(m['delta_points'])} points)"),
        (f"planted errors found, of {s['planted']}", f"{s['flagged']} ({percent(s['recall'])})", f"{s['corrected']} corrected"),
        (f"planted pairs found, of {d['pairs']}", f"{d['found']} ({percent(d['recall'])})", ""),
        (f"texts with personal data, of {m['pii']['planted']}", f"{m['pii']['found']} ({percent(m['pii']['recall'])})", f"{m['leaks']} left"),
        ("routed to people", f"{m['routed']} of {m['total']} ({percent(m['routed'] / max(1, m['total']))})", ""),
        ("time of review", f"{seconds / 60:.1f} minutes over {reviewed} decisions", ""), ("cost", f"{sum(c[4] for c in m['costs']):.4f} USD", "")])
    out += ["## Accuracy", "", *table(["Labels", "Accuracy"], [(k, percent(v)) for k, v in sorted(a.items())])]
    out += [f"{m['unreachable']['unreachable']} of {m['unreachable']['n']} texts have a truth that no leaf stands for; they count as errors.", ""]
    out += ["## Findings", "", *table(["Kind", "Findings"], m["flags"])]
    out += ["## Review", "", f"- routed: {m['routed']}", f"- decisions: {reviewed}", f"- median seconds: {m['median_seconds'] if m['median_seconds'] is not None else 'none'}", "", *table(["Decision", "Count", "Seconds"], [(k, n, f"{t:.1f}") for k, n, t in m["decisions"]])]
    out += ["## Abstention", "", f"- abstained: {ab['abstained']}", f"- ambiguous among abstained: {percent(ab['share'])}, among all {percent(ab['base_rate'])}",
            f"- second annotator right where the first abstained: {percent(ab['accuracy_abstained'])}, where it answered: {percent(ab['accuracy_answered'])}", ""]
    out += ["## Duplicates", "", f"{d['clusters']} clusters; {percent(d['precision'])} of them hold a planted pair. {d['explained']} of the {d['unmatched']} others have one shape throughout.", ""]
    out += ["## Cost", "", *table(["Stage", "Calls", "Tokens in", "Tokens out", "USD"], [(*c[:4], f"{c[4]:.4f}") for c in m["costs"]])]
    out += ["## Gates", "", *table(["Gate", "Value", "Bound", "Result"], m["gates"])]
    return "\n".join(out)


def datasheet(m: dict) -> str:
    """Markdown of an export: title, rows, exported, splits {name: n}, leaves, domains, fields, excluded [(reason, n)], labels
    [(label, n)], planted {kind: n}, routed, reviewed, seconds."""
    out = [f"# Datasheet: {m['title']}", "", "## Composition", "", f"- {m['rows']} texts, {m['exported']} of them exported", "- " + ", ".join(f"{n} {k}" for k, n in m["splits"].items()) + ", in equal shares of every label",
           f"- {len(m['leaves'])} labels in {m['domains']} domains", f"- fields: {', '.join(m['fields'])}", "", "Left out:", "", *[f"- {r}: {n}" for r, n in m["excluded"]], "", "### Labels", "", *table(["Label", "Texts"], m["labels"])]
    out += ["## Collection", "", "Planted defects: " + (", ".join(f"{n} {k}" for k, n in m["planted"].items()) or "none") + ".", "", "## Labels and review", "",
            f"Two annotators label every text. {m['routed']} texts were routed to people, who decided on {m['reviewed']} in {m['seconds'] / 60:.1f} minutes.", "",
            "## Limits", "", "Planted defects stand on texts of their own. Texts of one template are alike without being planted as pairs.", ""]
    return "\n".join(out)
