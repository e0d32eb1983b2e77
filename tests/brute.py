"""Plain-Python answers to the found queries, for comparison with the operators on small tables."""

from __future__ import annotations

import json
from collections import defaultdict

TYPES = {bool: "boolean", int: "number", float: "number", str: "string", dict: "object", list: "array"}


def strict(text):
    try:
        return json.loads(text)
    except (ValueError, TypeError):
        return None


def whole(x):
    try:
        return int(float(x)) if not isinstance(x, bool) and float(x) == int(float(x)) else None
    except (TypeError, ValueError):
        return None


def stamp(x):
    return (x is not None, x)


def p2(files):
    seen, out = set(), set()
    once = {r["file_id"]: r for r in files}
    for r in sorted(once.values(), key=lambda r: (stamp(r["written_at"]), r["file_id"])):
        for n, line in enumerate((r["content"] or "").split("\n"), 1):
            o = strict(line)
            if isinstance(o, dict):
                key = (r["path"].split("/")[0], whole(o.get("layer")), whole(o.get("segment_id")))
                if key in seen:
                    out.add((r["file_id"], n))
                seen.add(key)
    return out


def channels(colors):
    pairs = colors.items() if isinstance(colors, dict) else [(e.get("channel"), e.get("value")) for e in colors or []]
    return [(k, v) for k, v in pairs if k is not None and v is not None]


def header(kind, body):
    if kind == "metadata":
        return {f"params.{k}": TYPES[type(v)] for k, v in (body.get("params") or {}).items() if v is not None}
    fields = {}
    for c in body.get("contours") or []:
        for k, v in channels(c.get("color_avg")):
            fields.setdefault("color_avg", TYPES[type(c["color_avg"])])
            fields.setdefault(f"color_avg.{k}", TYPES[type(v)])
    return fields


def p3(files):
    series, out = defaultdict(dict), set()
    for r in files:
        if r["kind"] in ("layer", "metadata") and isinstance(body := strict(r["body"]), dict):
            h = header(r["kind"], body)
            if h or r["kind"] == "metadata":
                series[r["stack"], r["kind"]][r["file_id"]] = (stamp(r["written_at"]), r["file_id"], h)
    for files_of in series.values():
        before = None
        for _, f, h in sorted(files_of.values(), key=lambda x: x[:2]):
            if before is not None:
                out |= {(f, k, "retyped") for k in h if k in before and before[k] != h[k]}
                gone, new = set(before) - set(h), set(h) - set(before)
                if len(gone) == len(new) == 1:
                    out |= {(f, k, "renamed") for k in new}
                else:
                    out |= {(f, k, "removed") for k in gone} | {(f, k, "added") for k in new}
            before = h
    return out


def p5(files):
    out = set()
    for r in files:
        body = strict(r["body"])
        if not isinstance(body, dict):
            continue
        if r["kind"] == "layer":
            for c in filter(None, body.get("contours") or []):
                for name in ("color_avg", "color_std"):
                    out |= {(r["file_id"], whole(body["id"]), whole(c["id"]), f"{name}.{k}") for k, _ in channels(c.get(name))}
        elif r["kind"] == "feud":
            for layer in body.get("layers") or []:
                for c in layer.get("contours") or []:
                    if isinstance(c.get("label"), str) and c["label"].strip():
                        out.add((r["file_id"], whole(layer["id"]), whole(c["id"]), "label"))
    return out


def p6(cells, layers, files):
    labels, contours, documents = set(), set(), set()
    for r in layers:
        if r["deleted_at"] is None:
            labels |= {(r["stack"], r["layer"], i) for i in r["label_ids"] or []}
    bodies = [(r, strict(r["body"])) for r in files]
    for r, b in bodies:
        if r["kind"] == "layer" and r["deleted_at"] is None and isinstance(b, dict):
            documents.add((r["stack"], whole(b["id"])))
            contours |= {(r["stack"], whole(b["id"]), whole(c["id"])) for c in b.get("contours") or []}
    month = lambda t: t and t.strftime("%Y-%m")
    out = {("cell_measurements.segment_id", r["cell_id"], r["layer"], r["segment_id"], month(r["measured_at"])) for r in cells if r["segment_id"] and (r["stack"], r["layer"], r["segment_id"]) not in labels}
    for r, b in bodies:
        if r["kind"] == "feud" and isinstance(b, dict):
            for x in b.get("layers") or []:
                out |= {("feud.id", r["file_id"], whole(x["id"]), i, month(r["written_at"])) for c in x.get("contours") or [] if (i := whole(c["id"])) is not None and (r["stack"], whole(x["id"]), i) not in contours}
        if r["kind"] == "feed" and isinstance(b, dict):
            out |= {("feed.layer_ids", r["file_id"], i, i, month(r["written_at"])) for x in b.get("layer_ids") or [] if (i := whole(x)) is not None and (r["stack"], i) not in documents}
    return out
