"""A DAG of steps with idempotency keys: a step whose inputs, parameters and specification are unchanged isn't run again."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Mapping
from pathlib import Path

from semforge.functions.ids import content_hash
from semforge.operators.gates import safe_result

Handler = Callable[[Mapping, Mapping], Mapping]


class PipelineError(ValueError):
    """A specification with unknown, doubled or circular steps, or a step that failed on all its tries."""


def ordered(steps: list[dict]) -> list[dict]:
    """Steps after what they depend on; ties by id."""
    by = {s["id"]: s for s in steps}
    if len(by) < len(steps):
        raise PipelineError("a step is there twice")
    if unknown := sorted({d for s in steps for d in s.get("depends_on", ())} - set(by)):
        raise PipelineError(f"unknown steps {unknown}")
    out, done = [], set()
    while len(out) < len(steps):
        ready = sorted(i for i, s in by.items() if i not in done and set(s.get("depends_on", ())) <= done)
        if not ready:
            raise PipelineError("steps depend on each other in a circle")
        out.append(by[ready[0]])
        done.add(ready[0])
    return out


def run_dag(spec: Mapping, handlers: Mapping[str, Handler], manifest: str | None = None, retries: int = 1, previous: Mapping | None = None) -> dict:
    """Runs the steps (id, handler, depends_on, parameters) and returns the manifest; resumes from ``previous``, or from a file, which it replaces in one step."""
    path = Path(manifest) if manifest else None
    old = previous or (json.loads(path.read_text()) if path and path.exists() else {"steps": {}})
    state: dict = {"spec": content_hash(spec), "steps": {}}
    for step in ordered(list(spec["steps"])):
        inputs = {d: state["steps"][d]["output_hash"] for d in step.get("depends_on", ())}
        key = content_hash({"inputs": inputs, "parameters": step.get("parameters", {}), "handler": step["handler"], "spec": state["spec"]})
        before = old["steps"].get(step["id"])
        if before and before["key"] == key and before["status"] == "completed":
            state["steps"][step["id"]] = before | {"resumed": True}
            continue
        if step["handler"] not in handlers:
            raise PipelineError(f"no handler {step['handler']}")
        for left in range(retries, -1, -1):
            try:
                result = dict(safe_result(handlers[step["handler"]](step.get("parameters", {}), {d: state["steps"][d]["result"] for d in inputs})))
                break
            except Exception as e:
                if not left:
                    state["steps"][step["id"]] = {"key": key, "status": "failed", "error": str(e)[:500], "resumed": False}
                    _save(path, state)
                    raise PipelineError(f"{step['id']} failed: {e}") from e
        state["steps"][step["id"]] = {"key": key, "status": "completed", "result": result, "output_hash": content_hash(result), "resumed": False}
        _save(path, state)
    return state


def _save(path: Path | None, state: dict) -> None:
    if path:
        new = path.with_suffix(f".{os.getpid()}.tmp")
        new.write_text(json.dumps(state, sort_keys=True, indent=2, default=str))
        os.replace(new, path)
