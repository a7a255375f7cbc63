"""A plain sequential reading of a log, and of pairing and exclusion, to hold the plans against."""

from functools import partial



def _number(text, most=(1 << 63) - 1):
    t = text.strip() if text is not None else ""
    t = t[1:] if t.startswith("+") else t
    return int(t) if t.isascii() and t.isdigit() and int(t) <= most else None


def read(lines, most=(1 << 63) - 1, limit=65_536):
    """ops: id -> dict with stages and deps; the last cycle; names in order; number of refused lines."""
    number = partial(_number, most=most)
    cycle, first_cycle, ops, names, refused = 0, 0, {}, [], 0
    for n, line in enumerate(lines, 1):
        if n == 1:
            continue
        p = line.split("\t")
        cmd, arg = p[0], lambda k: p[k] if k < len(p) else None  # noqa: B023
        if cmd in ("C", "C="):
            v = number(arg(1))
            if v is None or (cmd == "C=" and v < cycle) or (cmd == "C" and cycle + v > most):
                refused += 1
                continue
            cycle = v if cmd == "C=" else cycle + v
            if cmd == "C=" and not ops:
                first_cycle = v
            continue
        if not cmd or (len(p) == 1 and "=" in cmd):
            continue
        if cmd not in "ILSERW" or len(cmd) != 1:
            refused += 1
            continue
        i = number(arg(1))
        if i is None:
            refused += 1
            continue
        if cmd == "I":
            if i in ops or number(arg(2)) is None or number(arg(3)) is None:
                refused += 1
            else:
                ops[i] = {"gid": number(p[2]), "tid": number(p[3]), "rid": None, "fetch": cycle, "end": None, "flushed": False, "incomplete": False, "label": "", "detail": "", "stages": [], "deps": [], "line": n}
            continue
        op = ops.get(i)
        if op is None:
            refused += 1
            continue
        if op["rid"] is not None and cmd != "L":
            refused += 1
        if cmd == "L":
            kind, text = number(arg(2)), line.split("\t", 3)[3] if len(p) > 3 else ""
            if kind is None or kind > 2 or (kind == 2 and not op["stages"]):
                refused += 1
            elif kind == 2:
                s = op["stages"][-1]
                s["labels"] = s["labels"] + "\n" + text if s["labels"] else text
            else:
                op["label" if kind == 0 else "detail"] += text
        elif cmd == "S":
            if len(p) < 4:
                refused += 1
                continue
            lane, name = p[2].strip(), p[3].strip()
            for x in (lane, name):
                if x not in names and (len(names) >= limit or len(x.encode()) > 256):
                    break
                names += [x] if x not in names else []
            else:
                x = None
            if x is not None:
                refused += 1
                continue
            for s in reversed(op["stages"]):
                if s["lane"] == lane and s["end"] is None:
                    s["end"] = cycle
                    break
            op["stages"].append({"lane": lane, "name": name, "start": cycle, "end": None, "labels": ""})
        elif cmd == "E":
            if len(p) < 4 or p[2].strip() not in names or p[3].strip() not in names:
                refused += 1
                continue
            for s in reversed(op["stages"]):
                if (s["lane"], s["name"]) == (p[2].strip(), p[3].strip()):
                    s["end"] = cycle
                    break
        elif cmd == "R":
            if op["rid"] is not None or number(arg(2)) is None or number(arg(3)) is None or number(p[3]) > 1:
                refused += 1
                continue
            op.update(rid=number(p[2]), end=cycle, flushed=number(p[3]) == 1)
            for s in op["stages"]:
                s["end"] = cycle if s["end"] is None else s["end"]
        elif cmd == "W":
            if number(arg(2)) is None or number(arg(3)) is None:
                refused += 1
                continue
            refused += number(p[2]) > i
            op["deps"].append((number(p[2]), number(p[3]), cycle))
    for op in ops.values():
        if op["rid"] is None:
            op.update(end=min(cycle + 1, most), incomplete=True)
            for s in op["stages"]:
                s["end"] = op["end"] if s["end"] is None else s["end"]
        for key in ("label", "detail"):
            op[key] = op[key].replace("\\n", "\n")
        for s in op["stages"]:
            s["labels"] = s["labels"].replace("\\n", "\n")
    return ops, first_cycle, cycle, names, refused


def pairs(sources, targets, skip=0):
    """(source, target) of points (tid, row, stage, cycle): the next later rows of the thread, one target a row."""
    best = {}
    for t in targets:
        k = (t[0], t[1])
        if k not in best or (t[3], t[2]) < (best[k][3], best[k][2]):
            best[k] = t
    out = []
    for s in sorted(sources, key=lambda x: (x[1], x[2])):
        later = sorted((t for t in best.values() if t[0] == s[0] and t[1] > s[1]), key=lambda t: t[1])
        if len(later) > skip:
            out.append((s, later[skip]))
    return out


def enclosed(pair, points, rows):
    (_, r1, _, c1), (_, r2, _, c2) = pair
    return any(min(c1, c2) < c < max(c1, c2) and (not rows or min(r1, r2) < r < max(r1, r2)) for r, c in points)
