"""Ways in: an environment file, skills, HTTP and the command line."""

from __future__ import annotations

import argparse
import json
import os
import re
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import yaml

from ..plans.policy import PolicyEngine
from ..semantic.build import bootstrap, lint
from ..semantic.model import Registry
from ..sources.registry import Source, Sources, load_config
from .ask import ask, command_client, guided_prompt, load_context
from .audit import AuditLog
from .dashboard import write
from .golden import evaluate, load_golden
from .tools import Service

# The parts of a skill.
HEADINGS = ("Goal", "Workflow", "Guardrails", "Completion")


def load_env(path: str | Path, env: dict | None = None) -> dict[str, str]:
    """NAME=value lines (export, quotes and # comments as in a shell) into env; names that are set already stay."""
    env = os.environ if env is None else env
    out = {}
    for n, line in enumerate(Path(path).read_text().splitlines(), 1):
        s = line.strip()
        if not s or s.startswith("#"):
            continue
        m = re.fullmatch(r"(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(?:'([^']*)'|\"((?:[^\"\\]|\\.)*)\"|([^#]*?))\s*(?:#.*)?", s)
        if not m:
            raise ValueError(f"{path}:{n}: not NAME=value")
        v = m[2] if m[2] is not None else re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), m[3]) if m[3] is not None else m[4]
        out[m[1]] = v
        if m[1] not in env:
            env[m[1]] = v
    return out


def load_skills(folder: str | Path) -> dict[str, dict]:
    out = {}
    for p in sorted(Path(folder).glob("*.md")):
        m = re.match(r"---\n(.*?)\n---\n(.*)", p.read_text(), re.S)
        head = yaml.safe_load(m[1]) if m else None
        if not isinstance(head, dict) or set(head) != {"name", "description"}:
            raise ValueError(f"{p}: front matter has name and description")
        if missing := [h for h in HEADINGS if not re.search(rf"^## {h}$", m[2], re.M)]:
            raise ValueError(f"{p}: lacks {', '.join(missing)}")
        out[head["name"]] = {"description": head["description"], "body": m[2].strip()}
    return out


def install_skill(path: str | Path, name: str, target: str) -> bool:
    """Add a pointer to a JSON file of skills, by an atomic write; True if it changed."""
    p = Path(path)
    doc = json.loads(p.read_text()) if p.exists() else {}
    if doc.get("skills", {}).get(name) == target:
        return False
    doc.setdefault("skills", {})[name] = target
    tmp = p.with_suffix(f".{os.getpid()}.tmp")
    tmp.write_text(json.dumps(doc, indent=2, sort_keys=True) + "\n")
    tmp.replace(p)
    return True


def serve(service: Service, port: int = 8080, principal_header: str = "X-Principal") -> ThreadingHTTPServer:
    """GET /health, POST /query and POST /tools/<name>; without a principal 401."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, body) -> None:
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self.answer(200, {"status": "ok"}) if self.path == "/health" else self.answer(404, {"error": "not found"})

        def do_POST(self) -> None:
            tool = "query" if self.path == "/query" else self.path.removeprefix("/tools/") if self.path.startswith("/tools/") else ""
            who = self.headers.get(principal_header)
            if not who:
                return self.answer(401, {"error": "E_PRINCIPAL_REQUIRED"})
            if tool not in service.tools():
                return self.answer(404, {"error": "no such tool"})
            try:
                args = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}")
                out = service.call(tool, args, who)
            except ValueError as e:
                return self.answer(400, {"error": str(e)})
            return self.answer(200 if out["ok"] else 400, out)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def main(argv: list[str] | None = None, spark=None) -> int:
    p = argparse.ArgumentParser(prog="lakewarden")
    p.add_argument("--config", default="lakewarden.json")
    p.add_argument("--semantic")
    p.add_argument("--policy")
    p.add_argument("--audit", default="audit.jsonl")
    p.add_argument("--principal", default=os.environ.get("LAKEWARDEN_PRINCIPAL"))
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("serve")
    s.add_argument("--port", type=int, default=8080)
    s = sub.add_parser("query")
    s.add_argument("source")
    s.add_argument("sql")
    s = sub.add_parser("bootstrap")
    s.add_argument("source")
    s.add_argument("output")
    s = sub.add_parser("lint")
    s.add_argument("source")
    s = sub.add_parser("golden")
    s.add_argument("source")
    s.add_argument("file")
    s = sub.add_parser("ask")
    s.add_argument("question")
    s.add_argument("--command", dest="client", nargs="+", required=True)
    s.add_argument("--context", default=".")
    s.add_argument("--direct", action="store_true")
    s = sub.add_parser("dashboard")
    s.add_argument("spec")
    s.add_argument("output")
    s = sub.add_parser("skills")
    s.add_argument("folder")
    s.add_argument("name", nargs="?")
    a = p.parse_args(argv)
    try:
        if a.command == "skills":
            skills = load_skills(a.folder)
            print(skills[a.name]["body"] if a.name else "\n".join(f"{k}: {v['description']}" for k, v in skills.items()))
            return 0
        if a.command == "dashboard":
            write(json.loads(Path(a.spec).read_text()), a.output)
            return 0
        registry = Registry.load(a.semantic) if a.semantic else None
        if a.command == "ask":
            text, queries = load_context(a.context)
            print(ask(a.question, command_client(a.client), None if a.direct else guided_prompt(a.question, registry or Registry([]), text, queries)))
            return 0
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("lakewarden").getOrCreate()
        configs = load_config(Path(a.config).read_text())
        if a.command in ("bootstrap", "lint"):
            source = Source(spark, next(c for c in configs if c.name == a.source))
            if a.command == "bootstrap":
                print("written" if bootstrap(source, a.output) else "unchanged")
                return 0
            found = lint(registry, source)
            print("\n".join(f.text(a.semantic) for f in found))
            return int(bool(found))
        policies = PolicyEngine(json.loads(Path(a.policy).read_text())) if a.policy else None
        service = Service(spark, Sources(spark, configs), AuditLog(a.audit, [c.password for c in configs]), registry, policies)
        if a.command == "serve":
            serve(service, a.port).serve_forever()
        if a.command == "golden":
            from ..plans.gate import GovernedSession

            r = evaluate(GovernedSession(spark, service.sources.by_name[a.source].tables, registry=registry), load_golden(Path(a.file).read_text(), a.file))
            print(r.text())
            return r.exit_code
        out = service.call("query", {"connectionId": a.source, "sql": a.sql}, a.principal or "")
        print(json.dumps(out["result" if out["ok"] else "error"], ensure_ascii=False), file=sys.stdout if out["ok"] else sys.stderr)
        return int(not out["ok"])
    except (OSError, ValueError, PermissionError, RuntimeError, KeyError, StopIteration) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
