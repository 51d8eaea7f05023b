"""Plan, tool choice, check and retry around pluggable callables; every step is kept and written as an event."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from fundspark.functions.gate import is_injection

MAX_ARG = 20_000


class BudgetExceeded(RuntimeError):
    pass


@dataclass
class Budget:
    """At most so many calls and seconds."""

    calls: int = 80
    seconds: float = 1200.0
    used: int = 0
    start: float = field(default_factory=time.monotonic)

    def charge(self) -> None:
        self.used += 1
        if self.used > self.calls or time.monotonic() - self.start > self.seconds:
            raise BudgetExceeded(f"{self.used} calls")


@dataclass
class Audit:
    """Events of a run as JSON lines; a failing sink never stops the run."""

    sink: Callable[[str], None] = lambda line: None
    run: str = field(default_factory=lambda: uuid.uuid4().hex[:12])

    def event(self, kind: str, **fields) -> None:
        try:
            self.sink(json.dumps({"ts": datetime.now(timezone.utc).isoformat(), "run_id": self.run, "event": kind, **fields}, ensure_ascii=False, default=str))
        except Exception:  # noqa: BLE001
            pass


def retry(f: Callable, tries: int = 3, wait: float = 0.0):
    """Calls ``f`` again after an error, waiting longer each time."""
    for k in range(tries):
        try:
            return f()
        except BudgetExceeded:
            raise
        except Exception:
            if k == tries - 1:
                raise
            time.sleep(wait * (k + 1))


def failed(result: str) -> bool:
    return not result.strip() or result.strip().startswith("Erreur")


def run(query: str, plan: Callable[[str], list[str]], choose: Callable[[str, list], tuple[str, dict]], tools: dict[str, Callable], answer: Callable[[str, list], str], audit: Audit | None = None, budget: Budget | None = None, max_retries: int = 1, tries: int = 1) -> dict:
    """Gate, plan, steps and answer. A tool that raises is called up to ``tries`` times. A step whose result is empty or an error is tried again with another choice; an answer needs some step that succeeded."""
    audit, budget = audit or Audit(), budget or Budget()
    audit.event("run_start", query=query)
    if is_injection(query):
        audit.event("security", allowed=False, category="injection")
        return {"status": "refused", "answer": "", "steps": []}
    steps: list[dict] = []
    try:
        budget.charge()
        for index, step in enumerate(plan(query)):
            for _ in range(max_retries + 1):
                budget.charge()
                name, args = choose(step, steps)
                if name not in tools or not isinstance(args, dict) or any(isinstance(v, str) and len(v) > MAX_ARG for v in args.values()):
                    result = f"Erreur : {name} can't be called so"
                else:
                    try:
                        result = str(retry(lambda: tools[name](**args), tries))
                    except Exception as e:  # noqa: BLE001
                        result = f"Erreur : {e}"
                ok = not failed(result)
                steps.append({"step": step, "tool": name, "args": args, "result": result[:1500], "ok": ok})
                audit.event("step", index=index, step=step, tool=name, args=args, ok=ok, result_preview=result[:500])
                if ok:
                    break
    except BudgetExceeded as e:
        audit.event("budget_exceeded", detail=str(e))
    done = [s for s in steps if s["ok"]]
    status = "ok" if done else "no_data"
    text = answer(query, done) if done else ""
    audit.event("run_end", status=status)
    return {"status": status, "answer": text, "steps": steps}


def select_metric(answer: dict | None, known: list[str], ask: Callable[[list[str]], str] | None = None, fallback: str = "sharpe") -> dict:
    """The metric of a selector's answer {metric, alternatives}: itself if known and alone, else what ``ask`` picks among the candidates, else the fallback."""
    first = str((answer or {}).get("metric") or "").strip().lower()
    others = [str(a).strip().lower() for a in (answer or {}).get("alternatives") or []]
    names = list(dict.fromkeys(m for m in (first, *others) if m in known))
    if len(names) > 1 and ask:
        picked = ask(names)
        if picked in names:
            return {"metric": picked, "how": "asked"}
    return {"metric": names[0], "how": "selected"} if names else {"metric": fallback, "how": "fallback"}


def parse_plan(text: str) -> list[str]:
    """Steps of a model's plan: a JSON list of texts or of tables, a table that holds one, or numbered lines."""
    import re

    body = text[min((k for k in (text.find("["), text.find("{")) if k >= 0), default=len(text)) :]
    for end in range(len(body), 0, -1) if len(body) < 20_000 else ():
        if body[end - 1] not in "]}":
            continue
        try:
            data = json.loads(body[:end])
        except ValueError:
            continue
        if isinstance(data, dict):
            data = next((v for v in data.values() if isinstance(v, list)), [])
        steps = [s if isinstance(s, str) else next((str(v) for k, v in s.items() if k in ("step", "etape", "description", "action")), "") if isinstance(s, dict) else str(s) for s in data]
        return [s.strip() for s in steps if s.strip()]
    return [m.strip() for m in re.findall(r"^\s*(?:\d+[.)]|[-*])\s+(.+)$", text, re.M)]


def ask_json(call: Callable[[], str], asks: int = 3) -> Any:
    """Calls a model until its answer holds JSON, at most so often; ValueError if none does."""
    for _ in range(asks):
        text = call()
        for at, ch in enumerate(text):
            if ch in "[{":
                try:
                    return json.JSONDecoder(strict=False).raw_decode(text[at:])[0]
                except ValueError:
                    continue
    raise ValueError("no JSON in the answer")


def last_deliverable(steps: list[dict]) -> str:
    """The last content that isn't blank among the steps' arguments."""
    return next((c for s in reversed(steps) if (c := str((s.get("args") or {}).get("content") or "").strip())), "")


def is_structured(step: dict) -> bool:
    """Whether a step's result comes from data: not a search of texts nor a file written, and neither empty nor a failure."""
    said = str(step.get("result") or "").strip()
    return step.get("tool") not in ("rag_search", "read_file", "write_file") and bool(said) and not failed(said) and not said.lower().startswith(("impossible", "aucune fiche"))


def synthesis(steps: list[dict]) -> tuple[str, str]:
    """(decision, text): ``ambiguous`` with the candidates where several funds fit and nothing else was found, ``no_data`` where every search was empty and nothing structured came, ``deliverable`` with what was written, else ``memory``."""
    structured = [s for s in steps if is_structured(s)]
    several = [s["result"] for s in steps if "several funds fit" in str(s.get("result"))]
    if several and not structured:
        return "ambiguous", several[-1]
    found = [s for s in steps if s.get("tool") == "rag_search" and s.get("ok")]
    if not structured and not found:
        return "no_data", ""
    text = last_deliverable(steps)
    return ("deliverable", text) if text else ("memory", "\n".join(str(s["result"]) for s in steps if s.get("ok")))


#: Arms of an ablation: which parts of the agent take part.
ARMS = {
    "A": {"tools": False, "rag": False, "gate": False}, "B": {"tools": False, "rag": True, "gate": False}, "C": {"tools": True, "rag": False, "gate": False},
    "D": {"tools": True, "rag": True, "gate": False}, "E": {"tools": True, "rag": True, "gate": True},
}


def run_arm(arm: str, query: str, plan: Callable, choose: Callable, tools: dict[str, Callable], answer: Callable, **kw: Any) -> dict:
    """``run`` with the parts of an arm only."""
    parts = ARMS[arm]
    kept = {n: f for n, f in tools.items() if (parts["rag"] if n == "rag_search" else parts["tools"])}
    if parts["gate"] or not is_injection(query):
        return run(query, plan if kept else (lambda q: []), choose, kept, answer, **kw)
    return run("", lambda q: plan(query) if kept else [], choose, kept, lambda q, done: answer(query, done), **kw)
