"""Prompts for a language model that runs elsewhere, and a paired comparison of guided and direct ones."""

from __future__ import annotations

import json
import re
import subprocess
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from pathlib import Path

from ..plans.execution import execute
from ..plans.gate import GovernedSession, build_plan
from ..semantic.model import Registry, _plain
from .golden import canonical, load_golden

# The marker of a scrubbed name, and what a single run says.
REDACTED = "[CLAC REDACTED]"
CAVEAT = "One seeded run is descriptive and does not establish statistical significance."


def load_context(folder: str | Path) -> tuple[str, list[dict]]:
    """(instructions, approved queries); either file may be absent."""
    a, b = Path(folder, "instructions.md"), Path(folder, "queries.yml")
    return (a.read_text() if a.exists() else ""), (load_golden(b.read_text(), str(b)) if b.exists() else [])


def command_client(command: Sequence[str], timeout_s: float = 120) -> Callable[[str], str]:
    """A program that takes the prompt on its standard input; no shell."""

    def ask(prompt: str) -> str:
        r = subprocess.run(list(command), input=prompt, capture_output=True, text=True, timeout=timeout_s, check=False)
        if r.returncode:
            raise RuntimeError(f"the model's command ended with {r.returncode}")
        return r.stdout

    return ask


def visible_document(registry: Registry, hidden: Iterable[str]) -> dict:
    veil = registry.spellings(hidden)
    words = lambda *x: {w.lower() for w in re.findall(r"\w+", " ".join(x))}
    models = []
    for m in registry.models.values():
        d = _plain(m)
        d["columns"] = [c for c in d["columns"] if not veil & {c["name"].lower(), c.get("sourceColumn", "").lower()}]
        models.append(d)
    metrics = [_plain(x) for x in registry.metrics.values() if not veil & words(x.expression)]
    kept = {x["name"] for x in metrics}
    cut = lambda e, **k: _plain(e) | {n: [c for c in v if c.lower() not in veil and (n not in ("metrics", "measures") or c in kept)] for n, v in k.items()}
    return {
        "models": models, "metrics": metrics,
        "relationships": [_plain(r) for r in registry.relationships.values() if not veil & words(*(c for k in r.joinKeys for c in k))],
        "views": [cut(v, columns=v.columns, metrics=v.metrics) for v in registry.views.values()], "cubes": [cut(c, dimensions=c.dimensions, measures=c.measures) for c in registry.cubes.values()],
    }


def guided_prompt(question: str, registry: Registry, instructions: str = "", approved: Sequence[dict] = (), precedents: Sequence[dict] = (), hidden: Iterable[str] = ()) -> str:
    """What a model needs to write one statement: the models it may name, the project's own rules, checked and unchecked examples,
    and the question last. What tells of a hidden column, by either of its names, is left out or scrubbed."""
    veil = sorted(registry.spellings(hidden), key=lambda h: (-len(h), h))
    name = rf"\b({'|'.join(map(re.escape, veil))})\b"
    tells = lambda x: bool(veil) and re.search(name, json.dumps(x, default=str), re.I)
    parts = ["Write one read-only SELECT in Spark SQL that answers the question at the end. Name only tables, columns and metrics listed here."]
    parts.append("### Models\n" + json.dumps(visible_document(registry, veil), indent=2, default=str))
    if instructions.strip():
        parts.append("### Rules of this project\n" + instructions.strip())
    for title, items in (("Checked examples", approved), ("Earlier statements, unchecked", precedents)):
        if shown := [x for x in items if not tells(x)]:
            parts.append(f"### {title}\n" + "\n".join(json.dumps(x, default=str) for x in shown))
    text = "\n\n".join([*parts, "### Question\n" + question])
    return re.sub(name, REDACTED, text, flags=re.I) if veil else text


def ask(question: str, client: Callable[[str], str], prompt: str | None = None) -> str:
    if not question.strip():
        raise ValueError("the question is empty")
    answer = client(prompt if prompt is not None else question.strip()).strip()
    if not answer:
        raise RuntimeError("the model's answer is empty")
    return answer


@dataclass(frozen=True)
class Paired:
    guided: int
    direct: int
    total: int
    seed: int

    def text(self) -> str:
        d = (self.guided - self.direct) / self.total * 100 if self.total else 0.0
        return f"guided {self.guided}/{self.total}, direct {self.direct}/{self.total}, delta {d:+.2f} pp\nCaveat: {CAVEAT}"


def benchmark(session: GovernedSession, registry: Registry, golden: Sequence[dict], client: Callable[[str, int], str], seed: int, instructions: str = "") -> Paired:
    """Each question guided, then direct, under the same seed; its own golden entry is not among the examples."""
    hits = [0, 0]
    for q in golden:
        others = [x for x in golden if x["question"] != q["question"]]
        for i, prompt in enumerate((guided_prompt(q["question"], registry, instructions, others), q["question"])):
            sql = re.sub(r"^```(?:sql)?\s*|\s*```$", "", client(prompt, seed).strip())
            try:
                plan = build_plan(session, sql)
                hits[i] += canonical(execute(plan), plan.ordered) == canonical(q["expected"], plan.ordered)
            except Exception:
                continue
    return Paired(hits[0], hits[1], len(golden), seed)
