"""Golden queries: results that must stay, and their promotion from approved executions."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from pathlib import Path

import yaml

from ..plans.execution import execute, plain
from ..plans.gate import MAX_ROWS, GovernedSession, build_plan
from ..semantic.model import ModelError, load_yaml


def load_golden(text: str, path: str = "queries.yml") -> list[dict]:
    raw = load_yaml(text, path) or {}
    items = raw.get("queries") or []
    for i, q in enumerate(items):
        if not isinstance(q, dict) or not set(q) <= {"question", "sql", "expected"} or not q.get("question") or not q.get("sql"):
            raise ModelError(f"queries[{i}] has question and sql, and rows expected", *getattr(q, "mark", (1, 1)), path)
    return [dict(q) for q in items]


def canonical(rows: list[dict], ordered: bool) -> list[str]:
    out = [json.dumps(plain(r), sort_keys=True, ensure_ascii=False) for r in rows]
    return out if ordered else sorted(out)


@dataclass(frozen=True)
class Report:
    passed: int
    total: int
    threshold: float
    failures: tuple[tuple[str, str], ...]

    @property
    def rate(self) -> float:
        return self.passed / self.total if self.total else 1.0

    @property
    def exit_code(self) -> int:
        return 0 if self.rate >= self.threshold else 1

    def text(self) -> str:
        head = f"Golden eval: {self.passed}/{self.total} passed ({self.rate * 100:.2f}%); threshold {self.threshold * 100:.2f}%"
        return "\n".join([head, *(f"FAIL {q}: {why}" for q, why in self.failures)])


def evaluate(session: GovernedSession, queries: list[dict], threshold: float = 1.0) -> Report:
    """A case without expected rows, or with any error, has failed; none is skipped."""
    bad = []
    for q in queries:
        try:
            if "expected" not in q:
                raise ValueError("no expected rows")
            plan = build_plan(session, q["sql"], default=MAX_ROWS)
            if canonical(execute(plan), plan.ordered) != canonical(q["expected"], plan.ordered):
                raise ValueError("the rows differ")
        except Exception as e:
            bad.append((q["question"], str(e)))
    return Report(len(queries) - len(bad), len(queries), threshold, tuple(bad))


def promote(path: str | Path, question: str, sql: str, expected: list[dict], approved: bool) -> bool:
    """Append an approved query; True if the file changed. The same entry again is no change, another one an error."""
    if approved is not True:
        raise ValueError("promotion needs approved=True")
    question, sql, p = question.strip(), sql.strip(), Path(path)
    if not question or not sql:
        raise ValueError("question and SQL are not empty")
    source = p.read_text() if p.exists() else "queries:\n"
    if re.search(r"^queries:\s*\[\s*\]\s*$", source, re.M):
        raise ValueError("an inline empty list can't be appended to")
    entry = {"question": question, "sql": sql, "expected": [dict(r) for r in expected]}
    for old in load_golden(source, str(p)):
        if old["question"] == question:
            if canonical([old], True) == canonical([entry], True):
                return False
            raise ValueError(f"there is another entry for: {question}")
    body = yaml.safe_dump([entry], sort_keys=False, allow_unicode=True, width=1000)
    text = source + ("" if source.endswith("\n") else "\n") + "".join(f"  {x}\n" for x in body.splitlines())
    load_golden(text, str(p))
    p.write_text(text)
    return True
