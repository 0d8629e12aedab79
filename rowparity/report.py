"""Reports of comparisons and batches: text, HTML, JUnit and report-tool JSON."""

from __future__ import annotations

import json
import re
from collections import Counter
from html import escape
from xml.sax.saxutils import quoteattr

from .batch import Batch
from .compare import Comparison


def findings(result: Comparison) -> list[str]:
    """At most three sentences on what matters most."""
    if result.equivalent:
        return ["All records are identical."]
    out = []
    if result.modified and result.field_changes:
        name, n = max(result.field_changes.items(), key=lambda x: (x[1], x[0]))
        out.append(f"{name.replace('_', ' ')} changed in {n / result.modified:.1%} of modified records.")
    elif result.left_only or result.right_only:
        out.append(f"Records differ by membership: {result.left_only:,} only in the first, {result.right_only:,} only in the second.")
    if result.shifts:
        out.append(shift_text(result.shifts[0]))
    if result.attribution:
        name, n = next(iter(result.attribution.items()))
        out.append(f"{name} has {n / sum(result.attribution.values()):.0%} of the changes that belong to a read group or sample.")
    if result.transitions:
        label, n = next(iter(result.transitions.items()))
        out.append(f"The most frequent change is {label} ({n:,}).")
    if result.structure:
        out.append(result.structure[0] + ".")
    return out[:3]


def shift_text(shift: dict) -> str:
    """A sentence on a metric that moved."""
    name = shift["metric"].replace("_", " ").capitalize()
    if shift["metric"].endswith("_rate"):
        return f"{name} {'rose' if shift['second'] > shift['first'] else 'fell'} from {shift['first']:.1%} to {shift['second']:.1%}."
    if shift["first"] == shift["second"]:
        return f"{name} has the same median, {shift['first']:g}, but its distribution moved by {shift['distance']:.0%}."
    return f"{name} moved from a median of {shift['first']:g} to {shift['second']:g}."


def text(result: Comparison) -> str:
    """A report for a terminal."""
    lines = [
        f"{result.first} and {result.second}: {'equivalent' if result.equivalent else 'different'} ({result.relation})",
        f"records {result.n_left:,} and {result.n_right:,}, overlap {result.overlap:.1%}, similarity {result.similarity:.1%}",
    ]
    if result.identical is not None:
        lines.append(f"identical {result.identical:,}, modified {result.modified:,}, only in first {result.left_only:,}, only in second {result.right_only:,}")
    lines += [f"changed fields: {', '.join(result.changed_fields)}"] if result.changed_fields else []
    lines += [f"  {n:>10,}  {label}" for label, n in list(result.transitions.items())[:10]]
    return "\n".join([*lines, *result.structure, *findings(result)]) + "\n"


def _table(head: list[str], rows: list[list]) -> str:
    cells = lambda tag, row: "<tr>" + "".join(f"<{tag}>{escape(str(c))}</{tag}>" for c in row) + "</tr>"
    return "<table>" + cells("th", head) + "".join(cells("td", r) for r in rows) + "</table>"


def _page(title: str, body: str) -> str:
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title><style>body{{font:15px sans-serif;margin:2em}}td,th{{padding:.2em .8em;text-align:left}}</style></head><body><h1>{escape(title)}</h1>{body}</body></html>"


def html(result: Comparison) -> str:
    """A page that needs no other file."""
    counts = _table(["identical", "modified", "only in first", "only in second"], [[result.identical, result.modified, result.left_only, result.right_only]])
    body = "".join(f"<p>{escape(x)}</p>" for x in findings(result)) + counts + _table(["field", "changes"], [list(x) for x in result.field_changes.items()])
    if result.shifts:
        body += _table(["metric", "distance", "first", "second"], [[x["metric"], f"{x['distance']:.3f}", f"{x['first']:g}", f"{x['second']:g}"] for x in result.shifts])
    if result.examples:
        show = lambda x: json.dumps(x, sort_keys=True, ensure_ascii=False)
        body += _table(["status", "key", "before", "after"], [[x["status"], *(show(x[c]) for c in ("key", "before", "after"))] for x in result.examples])
    states, cells = transition_matrix(result)
    if states:
        body += _table(["from \\ to", *states], [[s, *row] for s, row in zip(states, cells, strict=True)])
    return _page(f"{result.first} and {result.second}", body + _table(["change", "records"], [list(x) for x in list(result.transitions.items())[:50]]))


def svg(result: Comparison, most: int = 12) -> str:
    """A figure: the counts, and a bar for each of the ``most`` frequent changes, else fields."""
    bars = list((result.transitions or result.field_changes).items())[:most]
    top = max([n for _, n in bars], default=1)
    width, row, first = 900, 26, 110
    height = first + row * max(1, len(bars)) + 20
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" font-family="sans-serif" font-size="14"><rect width="{width}" height="{height}" fill="white"/>']
    say = lambda x, y, text, more="": out.append(f'<text x="{x}" y="{y}"{more}>{escape(text)}</text>')
    say(20, 34, f"{result.first} and {result.second}: {result.relation}", ' font-size="18"')
    counts = "not matched" if result.identical is None else f"identical {result.identical:,}, modified {result.modified:,}, only in first {result.left_only:,}, only in second {result.right_only:,}"
    say(20, 60, f"records {result.n_left:,} and {result.n_right:,}; {counts}")
    say(20, 84, f"overlap {result.overlap:.1%}, similarity {result.similarity:.1%}")
    for k, (label, n) in enumerate(bars):
        y = first + k * row
        say(20, y + 15, label if len(label) <= 44 else label[:43] + "…")
        out.append(f'<rect x="380" y="{y}" width="{max(1, round(420 * n / top))}" height="18" fill="#4a6fa5"/>')
        say(390 + round(420 * n / top), y + 14, f"{n:,}")
    if not bars:
        say(20, first + 15, "No changes to show.")
    return "".join([*out, "</svg>"])


def transition_matrix(result: Comparison, most: int = 8) -> tuple[list[str], list[list[int]]]:
    """States and the counts of moves between the ``most`` frequent: of genotypes, else of mapping qualities."""
    for kind in (r"genotype .*", "MAPQ"):
        moves = [(m[1], m[2], n) for label, n in result.transitions.items() if (m := re.fullmatch(rf"{kind}: (.+?) → (.+)", label))]
        if moves:
            weight = Counter()
            for a, b, n in moves:
                weight.update({a: n})
                weight.update({b: n})
            states = [s for s, _ in sorted(weight.items(), key=lambda x: (-x[1], x[0]))[:most]]
            cells = Counter()
            for a, b, n in moves:
                cells[a, b] += n
            return states, [[cells[a, b] for b in states] for a in states]
    return [], []


def batch_text(batch: Batch) -> str:
    lines = [f"{'pass' if batch.passed else 'fail'}: {sum(i.passed for i in batch.items)} of {len(batch.items)} comparisons"]
    for item in batch.items:
        lines.append(f"{'ok  ' if item.passed else 'FAIL'} {item.sample} / {item.stage}" + "".join(f"\n       {v}" for v in item.violations))
    lines += [f"{sample}: first differs at {stage}" for sample, stage in batch.earliest_divergence.items()]
    return "\n".join(lines) + "\n"


def batch_html(batch: Batch) -> str:
    status = {(i.sample, i.stage): "pass" if i.passed else "fail" for i in batch.items}
    stages = list(dict.fromkeys(i.stage for i in batch.items))
    grid = [[s, *(status.get((s, t), "") for t in stages), batch.earliest_divergence.get(s, "")] for s in dict.fromkeys(i.sample for i in batch.items)]
    return _page("Batch", _table(["sample", *stages, "first difference"], grid) + _table(["change", "records"], [list(x) for x in list(batch.transitions.items())[:20]]))


def matrix_html(names: list[str], rows: list[list[float]], outliers: list[str]) -> str:
    """A heat table of similarities, in the order of ``names``."""
    cell = lambda v: f"<td style='background:rgba(74,111,165,{v:.3f})'>{v:.3f}</td>"
    body = "".join(f"<tr><th>{escape(n)}{' (outlier)' if n in outliers else ''}</th>{''.join(map(cell, row))}</tr>" for n, row in zip(names, rows, strict=True))
    return _page("Similarity", f"<table><tr><th></th>{''.join(f'<th>{escape(n)}</th>' for n in names)}</tr>{body}</table>")


def junit(batch: Batch) -> str:
    """A test case for each comparison."""
    cases = []
    for item in batch.items:
        fail = "" if item.passed else f"<failure message={quoteattr('; '.join(item.violations))}/>"
        cases.append(f"<testcase classname={quoteattr(item.sample)} name={quoteattr(item.stage)} time=\"{item.seconds:.3f}\">{fail}</testcase>")
    failures = sum(not i.passed for i in batch.items)
    return f'<?xml version="1.0" encoding="UTF-8"?><testsuite name="rowparity" tests="{len(batch.items)}" failures="{failures}">{"".join(cases)}</testsuite>'


def multiqc(batch: Batch) -> str:
    """Custom content for a report tool: a row for each comparison."""
    data = {f"{i.sample} / {i.stage}": {"passed": i.passed, "modified": i.result.modified, "only": i.result.left_only + i.result.right_only, "overlap": i.result.overlap} for i in batch.items}
    return json.dumps({"id": "rowparity", "section_name": "rowparity", "plot_type": "table", "data": data}, indent=2, sort_keys=True)
