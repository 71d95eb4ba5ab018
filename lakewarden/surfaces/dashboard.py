"""Self-contained dashboards, and their deployment after a person's one-time confirmation."""

from __future__ import annotations

import html
import json
import secrets
import time
import urllib.request
from pathlib import Path

_HEAD = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><meta name="viewport" content="width=device-width, initial-scale=1">
<meta http-equiv="Content-Security-Policy" content="default-src 'none'; style-src 'unsafe-inline'; script-src 'unsafe-inline'; img-src data:">
"""
_STYLE = "<style>body{font:16px system-ui;margin:2rem auto;max-width:70rem}section{display:flex;flex-wrap:wrap;gap:1rem}article{border:1px solid #ccd;border-radius:.5rem;padding:1rem;min-width:12rem}b{display:block;font-size:1.7rem}</style>"
_SCRIPT = """<script>
const spec = JSON.parse(document.getElementById("data").textContent), picks = [...document.querySelectorAll("select")];
for (const p of picks) for (const v of new Set(spec.metrics.map(m => (m.dimensions || {})[p.name]).filter(v => v !== undefined))) p.add(new Option(String(v), String(v)));
const show = () => spec.metrics.forEach((m, i) => { document.getElementById("m" + i).hidden = picks.some(p => p.value && String((m.dimensions || {})[p.name]) !== p.value); });
picks.forEach(p => p.addEventListener("change", show));
</script>"""


def check_spec(spec: dict) -> dict:
    """{"title", "metrics": [{"name", "label"?, "value", "unit"?, "dimensions"?}]}, scalar values only."""
    scalar = lambda v: v is None or isinstance(v, (str, int, float, bool))
    if set(spec) != {"title", "metrics"} or not isinstance(spec["title"], str) or not spec["title"].strip() or not spec["metrics"]:
        raise ValueError("a dashboard has a title and metrics")
    for m in spec["metrics"]:
        if not set(m) <= {"name", "label", "value", "unit", "dimensions"} or not m.get("name") or "value" not in m:
            raise ValueError("a metric has a name and a value")
        if not scalar(m["value"]) or not all(scalar(v) for v in (m.get("dimensions") or {}).values()):
            raise ValueError(f"{m['name']}: values are scalars")
    return spec


def generate(spec: dict) -> str:
    s = check_spec(spec)
    data = json.dumps(s, ensure_ascii=False).replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e")
    e = lambda v: html.escape("—" if v is None else str(v), quote=True)
    filters = "".join(f'<label>{e(f)} <select name="{e(f)}"><option value="">All</option></select></label> ' for f in sorted({d for m in s["metrics"] for d in m.get("dimensions") or {}}))
    cards = "".join(
        f'<article id="m{i}">{e(m.get("label") or m["name"])}<b>{e(m["value"])}{" " + e(m["unit"]) if m.get("unit") else ""}</b>{", ".join(f"{e(k)}: {e(v)}" for k, v in sorted((m.get("dimensions") or {}).items()))}</article>' for i, m in enumerate(s["metrics"])
    )
    return f'{_HEAD}<title>{e(s["title"])}</title>{_STYLE}</head><body><h1>{e(s["title"])}</h1><form>{filters}</form><section>{cards}</section><script type="application/json" id="data">{data}</script>{_SCRIPT}</body></html>\n'


def write(spec: dict, path: str | Path) -> None:
    Path(path).write_text(generate(spec), encoding="utf-8")


class Confirmations:
    """Tokens that a person is shown and that work once, for a while, for one text."""

    def __init__(self, seconds: float = 300):
        self.seconds, self._open = seconds, {}

    def issue(self, page: str) -> str:
        token = secrets.token_urlsafe(18)
        self._open[token] = (hash(page), time.monotonic() + self.seconds)
        return token

    def use(self, token: str, page: str) -> None:
        kept = self._open.pop(token, None)
        if kept is None or kept[0] != hash(page) or time.monotonic() > kept[1]:
            raise PermissionError("the deployment is not confirmed")


def deploy(page: str, endpoint: str, bearer: str, confirmations: Confirmations, token: str, site: str | None = None, post=None) -> str:
    """Post the page; returns its address. post(request) -> bytes can be given for tests."""
    confirmations.use(token, page)
    if not endpoint.startswith("https://"):
        raise ValueError("the endpoint is https")
    body = ({"siteName": site} if site else {}) | {"files": [{"path": "index.html", "content": page}]}
    r = urllib.request.Request(endpoint, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {bearer}"}, method="POST")
    answer = post(r) if post else urllib.request.urlopen(r, timeout=30).read()
    url = json.loads(answer).get("url")
    if not isinstance(url, str) or not url:
        raise RuntimeError("the deployment has no address")
    return url
