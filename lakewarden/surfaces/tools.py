"""The six tools of a service: list_sources, describe_model, dry_plan, list_metrics, query, search_context."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..errors import GovernanceError, JoinPathError
from ..operators.retrieval import Memory, result_shape
from ..plans.documents import build_document_plan
from ..plans.execution import MAX_BYTES, TIMEOUT_MS, check_scalar, execute, plain, row_count
from ..plans.gate import GovernedSession, build_plan, dry_plan
from ..plans.policy import OPEN, PolicyEngine
from ..semantic.compiler import compile_selection
from ..semantic.model import Registry
from ..sources.registry import Sources
from .audit import AuditLog, as_principal, current_principal, redact

# Fixed value: how a past query is labelled.
PRIOR_ART = "PRIOR ART — example only, not ground truth"


@dataclass
class Service:
    spark: SparkSession
    sources: Sources
    audit: AuditLog
    registry: Registry | None = None
    policies: PolicyEngine | None = None
    memory: Memory | None = None
    timeout_ms: int = TIMEOUT_MS
    max_bytes: int = MAX_BYTES
    _sessions: dict = field(default_factory=dict)

    def session(self, source: str) -> GovernedSession:
        who = current_principal()
        if source not in self.sources.by_name:
            raise GovernanceError("E_UNKNOWN_TABLE", f"Unknown source: {source}", didYouMean=[])
        if (source, who) not in self._sessions:
            policy = self.policies.resolve(who) if self.policies else OPEN
            self._sessions[source, who] = GovernedSession(self.spark, self.sources.by_name[source].tables, policy, self.registry)
        return self._sessions[source, who]

    def hidden(self) -> dict[str, str]:
        policy = self.policies.resolve(current_principal()) if self.policies else OPEN
        return {c: n for _, c, n in policy.hidden}

    def list_sources(self) -> list[dict]:
        return self.sources.list_sources()

    def describe_model(self, model: str) -> dict:
        m = self.registry.model(model)
        policy = self.policies.resolve(current_principal()) if self.policies else OPEN
        m = self.registry.visible(model, policy.hidden_of(m.name, m.table))
        return {"name": m.name, "table": m.table, "description": m.description, "verified": m.verified, "columns": [{"name": c.name, "dataType": c.dataType, "description": c.description} for c in m.columns]}

    def list_metrics(self) -> list[dict]:
        """Metrics of visible columns only."""
        out = []
        policy = self.policies.resolve(current_principal()) if self.policies else OPEN
        for x in self.registry.metrics.values():
            m = self.registry.model(x.model)
            words = {w.lower() for w in re.findall(r"\w+", x.expression)}
            if not words & self.registry.spellings(policy.hidden_of(m.name, m.table), m.name):
                out.append({"name": x.name, "model": x.model, "expression": x.expression, "description": x.description})
        return out

    def dry_plan(self, connectionId: str, sql: str, params: list | None = None) -> dict:
        return dry_plan(self.session(connectionId), sql, params or ())

    def query(self, connectionId: str, sql: str | None = None, query=None, params: list | None = None, question: str | None = None) -> dict:
        if (sql is None) == (query is None):
            raise ValueError("either sql or query")
        at = time.monotonic()
        with self.audit.execution(connectionId, sql if sql is not None else str(query), current_principal()) as seen:
            s = self.session(connectionId)
            document = None if sql is not None else build_document_plan(s, query)
            plan = build_plan(s, sql, params or ()) if document is None else document.plan
            seen["appliedPolicies"] = plan.applied_policies
            rows = execute(plan, self.timeout_ms, self.max_bytes)
            result = rows if document is None else document.result(rows)
            if not isinstance(result, list):
                check_scalar(result, self.max_bytes)
            seen["rowCount"] = row_count(result)
        if question and self.memory:
            self.memory.record(question, plan.sql, result_shape(plan.frame.schema), (time.monotonic() - at) * 1000, self.unverified(plan.relations))
        return {"connectionId": connectionId, "type": self.sources.by_name[connectionId].config.type, "appliedLimit": plan.applied_limit, "appliedPolicies": list(plan.applied_policies), "results": plain(result)}

    def metric(self, connectionId: str, metric: str, dimensions: list[str] | None = None, limit: int = 1000) -> dict:
        """The compiler as a tool of its own."""
        with self.audit.execution(connectionId, f"{metric} by {dimensions or []}", current_principal()) as seen:
            plan = compile_selection(self.session(connectionId), self.registry, metric, dimensions or (), limit)
            seen["appliedPolicies"] = plan.applied_policies
            rows = execute(plan, self.timeout_ms, self.max_bytes)
            seen["rowCount"] = len(rows)
        return {"sql": plan.sql, "appliedPolicies": list(plan.applied_policies), "results": plain(rows)}

    def unverified(self, relations) -> list[str]:
        names = {r.lower() for r in relations}
        return sorted(m.name for m in self.registry.models.values() if not m.verified and (m.table.lower() in names or m.name.lower() in names)) if self.registry else []

    def search_context(self, query: str, limit: int = 5) -> list[dict]:
        if not 1 <= limit <= 20:
            raise ValueError("the limit is 1 to 20")
        if self.memory is None:
            return []
        veil = self.registry.spellings(self.hidden()) if self.registry else set(self.hidden())
        out = []
        for r in self.memory.search(query, limit):
            if veil & {w.lower() for w in re.findall(r"\w+", f"{r['question']} {r['sql']}")}:
                continue
            out.append({"label": PRIOR_ART, "question": r["question"], "sql": r["sql"], "score": r["score"]} | ({"warning": f"UNVERIFIED MODEL: {', '.join(r['unverified_models'])}"} if r["unverified_models"] else {}))
        return out

    def tools(self) -> dict[str, Callable]:
        return {n: getattr(self, n) for n in ("list_sources", "describe_model", "dry_plan", "list_metrics", "query", "search_context")}

    def call(self, tool: str, args: dict, principal: str) -> dict:
        """Errors come back as data; only an unknown tool is raised. A principal among the arguments is ignored."""
        fn = self.tools()[tool]
        with as_principal(principal):
            try:
                return {"ok": True, "result": fn(**{k: v for k, v in args.items() if k != "principal"})}
            except GovernanceError as e:
                return {"ok": False, "error": e.detail}
            except JoinPathError as e:
                return {"ok": False, "error": {"code": e.code, "message": str(e)}}
            except (TypeError, ValueError) as e:
                return {"ok": False, "error": {"code": "INVALID_ARGUMENTS", "message": redact(str(e), self.audit.secrets)}}
            except Exception as e:
                return {"ok": False, "error": {"code": "EXECUTION_FAILED", "message": redact(str(e), self.audit.secrets)}}
