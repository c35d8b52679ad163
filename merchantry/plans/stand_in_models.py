"""Deterministic stand-ins for the injectable model functions.

They let the model-function routes run end to end on the supplied tables without a
model server: same call shape (a batch of prompt / request strings in, reply strings
out), fully reproducible.
"""
from __future__ import annotations

import json
import re

_DESC = re.compile(r"Descript(?:ion|or): \"([^\"\n]*)\"")
_CUT = re.compile(r"\s*(#\d+|\b[FS]?\d{3,}).*$")


def echo_generator(prompts: list[str]) -> list[str]:
    """Reads the description out of the prompt, drops trailing ids and title-cases it."""
    out = []
    for p in prompts:
        m = _DESC.findall(p or "")
        desc = m[-1] if m else ""
        name = _CUT.sub("", desc).strip().title()
        out.append("Answer: " + json.dumps({"canonical_merchant": name, "category": "Shopping & Retail"}))
    return out


def first_candidate_chooser(payloads: list[str]) -> list[str]:
    """Picks the first offered merchant whose first word occurs in the description,
    else ``none_of_these``; category answer is the first allowed category."""
    res = []
    for p in payloads:
        req = json.loads(p)
        desc = (req.get("state") or {}).get("description", "").lower()
        crit = ((req.get("questions") or {}).get("merchant") or {}).get("criteria") or {}
        names = [n for n in crit if n != "none_of_these"]
        choice = next((n for n in names if n.split() and n.split()[0].lower() in desc), "none_of_these")
        conf = 0.9 if choice != "none_of_these" else 0.6
        cats = list(((req.get("questions") or {}).get("category") or {}).get("criteria") or {})
        res.append(json.dumps({"answers": {
            "merchant": {"choice": choice, "confidence": conf,
                         "probabilities": {choice: conf, "none_of_these": round(1 - conf, 3)}},
            "category": {"choice": cats[0] if cats else None, "confidence": 0.5, "probabilities": {}}},
            "usage": {"input_tokens": len(p) // 4}}))
    return res
