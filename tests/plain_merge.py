"""A merge of one document at a time in plain Python, to hold the joins of the library against.

A timeline is {"name", "start", "tracks": [{"uuid", "name", "kind", "enabled", "items": [item]}]}; an item has
kind, uuid, name, url, start, dur, enabled and marks, a list of (marker, label).
"""

from __future__ import annotations

import bisect
from collections import Counter
from itertools import product

FIELDS = ("kind", "uuid", "name", "url", "start", "dur", "enabled")


def content(i):
    if i["url"] is None and i["start"] is None and i["kind"] != "transition":
        return None
    return i["kind"], i["url"], i["start"], i["dur"]


def places(tl):
    return [(t, i) for t, track in enumerate(tl["tracks"]) for i in range(len(track["items"]))]


def at(tl, p):
    return tl["tracks"][p[0]]["items"][p[1]]


def greedy(base, side, base_left, side_left, key_b, key_s):
    """Pairs of equal keys in order; both lists of places lose what is paired."""
    out = []
    for s in list(side_left):
        k = key_s(s)
        b = next((b for b in base_left if k is not None and key_b(b) == k), None)
        if b is not None:
            out.append((b, s))
            base_left.remove(b)
            side_left.remove(s)
    return out


def by_uuid(pairs_of, base_left, side_left, uuid_b, uuid_s):
    last = {uuid_b(b): b for b in base_left if uuid_b(b) is not None}
    out = []
    for s in list(side_left):
        b = last.pop(uuid_s(s), None)
        if b is not None:
            out.append((b, s))
            base_left.remove(b)
            side_left.remove(s)
    return out


def track_pairs(base, side):
    bl, sl = list(range(len(base["tracks"]))), list(range(len(side["tracks"])))
    b, s = base["tracks"], side["tracks"]
    got = by_uuid(None, bl, sl, lambda t: b[t]["uuid"], lambda t: s[t]["uuid"])
    got += greedy(base, side, bl, sl, lambda t: (b[t]["name"], b[t]["kind"]), lambda t: (s[t]["name"], s[t]["kind"]))
    return {y: x for x, y in got + list(zip(bl, sl))}


def item_pairs(base, side):
    """(base place, side place, rung)."""
    bl, sl = places(base), places(side)
    out = [(b, s, 0) for b, s in by_uuid(None, bl, sl, lambda p: at(base, p)["uuid"], lambda p: at(side, p)["uuid"])]
    named = lambda tl: lambda p: (at(tl, p)["name"], tl["tracks"][p[0]]["name"]) if at(tl, p)["name"] else None
    out += [(b, s, 1) for b, s in greedy(base, side, bl, sl, named(base), named(side))]
    out += [(b, s, 2) for b, s in greedy(base, side, bl, sl, lambda p: content(at(base, p)), lambda p: content(at(side, p)))]
    lead = {}
    for b, s, r in sorted(out, key=lambda x: (x[2], x[1])):
        lead.setdefault(s[0], b[0])
    gap = lambda i: i["kind"] == "gap" and not i["name"]
    where = lambda p: lead.get(p[0], min(p[0], len(base["tracks"]) - 1))
    out += [(b, s, 3) for b, s in greedy(base, side, bl, sl, lambda p: p[0] if gap(at(base, p)) else None, lambda p: where(p) if gap(at(side, p)) else None)]
    return out


def key_of(i, p):
    return f"uuid:{i['uuid']}" if i["uuid"] is not None else f"name:{i['name']}" if i["name"] else f"fp:{content(i)}" if content(i) else f"pos:{p}"


def edits(base, side):
    """Edits as dicts; None if a gap known by its place alone moved."""
    to = track_pairs(base, side)
    new = [t for t in range(len(side["tracks"])) if t not in to]
    gone = set(range(len(base["tracks"]))) - set(to.values())
    pairs = item_pairs(base, side)
    home = {s: b for b, s, _ in pairs}
    out = [{"kind": "track_add", "at": (to_n,), "st": t, "track": side["tracks"][t]} for to_n, t in enumerate(new)]
    out += [{"kind": "track_remove", "at": (t,), "bt": t} for t in sorted(gone)]
    order = [to[t] for t in range(len(side["tracks"])) if t in to]
    if order and order != list(range(len(base["tracks"]))):
        out.append({"kind": "track_reorder", "at": (), "order": order, "same": order})
    for t, b in to.items():
        for a in ("name", "enabled"):
            if side["tracks"][t][a] != base["tracks"][b][a]:
                out.append({"kind": "track_attr", "at": (b, a), "bt": b, "attr": a, "value": side["tracks"][t][a], "same": side["tracks"][t][a]})
    stay = set()
    for t, track in enumerate(side["tracks"]):
        seq = [home[t, i] for i in range(len(track["items"])) if (t, i) in home and home[t, i][0] == to.get(t)]
        tops = []
        for _, x in seq:
            k = bisect.bisect_left(tops, x)
            tops[k : k + 1] = [x]
        stay |= {(to[t], x) for x in tops} if seq else set()

    def spot(s, moved):
        if s[0] in new:
            return ("new", new.index(s[0])), ("new", s[1])
        behind = next((home[s[0], j] for j in range(s[1] + 1, len(side["tracks"][s[0]]["items"])) if (s[0], j) in home), None)
        return ("base", to[s[0]]), ("before", *behind) if behind else ("end", s[0] if moved else to[s[0]])

    for b, s, rung in pairs:
        x, y = at(base, b), at(side, s)
        common = {"key": key_of(x, b), "b": b}
        if to.get(s[0]) != b[0] or b not in stay:
            if rung == 3:
                return None
            loc, slot = spot(s, True)
            out.append({"kind": "move", "at": b, **common, "loc": loc, "slot": slot, "s": s, "same": (loc, slot)})
        for a, f in (("name", "name"), ("enabled", "enabled"), ("media", "url")):
            if x[f] != y[f]:
                v = (y[f] or "") if a == "media" else y[f]
                out.append({"kind": "attr", "at": (*b, a), **common, "attr": a, "value": v, "same": v})
        if (x["start"] is None) != (y["start"] is None):
            v = None if y["start"] is None else (y["start"], y["dur"])
            out.append({"kind": "attr", "at": (*b, "range"), **common, "attr": "range", "value": v, "same": v})
        elif x["start"] is not None and (x["start"], x["dur"]) != (y["start"], y["dur"]):
            cut = y["start"] - x["start"], x["start"] + x["dur"] - y["start"] - y["dur"]
            out.append({"kind": "trim", "at": b, **common, "cut": cut, "same": cut})
        had, has = [m for m, _ in x["marks"]], [m for m, _ in y["marks"]]
        out += [{"kind": "marker_add", "at": (*b, m), **common, "mark": (m, v), "same": v} for m, v in y["marks"] if m not in had]
        out += [{"kind": "marker_remove", "at": (*b, m), **common, "mark": (m, None)} for m in had if m not in has]
    for s in places(side):
        if s not in home:
            loc, slot = spot(s, False)
            y = at(side, s)
            out.append({"kind": "insert", "at": s, "s": s, "item": y, "loc": loc, "slot": slot, "same": (y["kind"], y["url"], y["start"], y["dur"], y["name"])})
    matched = {b for b, _, _ in pairs}
    out += [{"kind": "remove", "at": b, "key": key_of(at(base, b), b), "b": b} for b in places(base) if b not in matched and b[0] not in gone]
    return out


def within(e, t):
    slots = [e["slot"][1]] if e.get("slot", ("new",))[0] in ("before", "end") else []
    into = [e["loc"][1]] if e.get("loc", ("new",))[0] == "base" else []
    return t in slots + into + ([e["b"][0]] if "b" in e else []) + ([e["bt"]] if e["kind"] == "track_attr" else [])


def meets(o, t):
    k = (o["kind"], t["kind"])
    return bool(
        ("key" in o and "key" in t and o["key"] == t["key"])
        or ("slot" in o and "slot" in t and (o["loc"], o["slot"]) == (t["loc"], t["slot"]))
        or (o["kind"] == "track_remove" and within(t, o["bt"]))
        or (t["kind"] == "track_remove" and within(o, t["bt"]))
        or (k == ("track_attr", "track_attr") and o["bt"] == t["bt"])
        or k in (("track_add", "track_add"), ("track_reorder", "track_reorder"))
    )


def judge(o, t, semantic):
    """(class, verdict, once)."""
    a, b = o["kind"], t["kind"]
    kinds, same = {a, b}, a == b and o.get("same") == t.get("same")
    marks = {"marker_add", "marker_remove"}
    if "insert" in kinds:
        return (0, "auto", False) if a != b else (6, "auto", True) if same else (8, "note", False)
    if "remove" in kinds:
        return (6, "auto", False) if a == b else (9, "human", False) if "track_remove" in kinds else (7, "human", False)
    if "track_remove" in kinds:
        return 9, "human", False
    if a != b and kinds & {"track_attr", "track_add", "track_reorder"}:
        return 0, "auto", False
    if a == b == "move":
        return 4, "auto" if same else "human", same
    if kinds == {"move", "trim"}:
        return 5, "auto", False
    if kinds == marks:
        return 3, "human", False
    if a != b:
        return 2, "auto", False
    if a == "marker_add":
        return (6, "auto", True) if same else (1, "auto", False)
    if a == "marker_remove":
        return 6, "auto", False
    if a == "track_add":
        return 0, "auto", False
    if a == "track_reorder":
        return (6, "auto", True) if same else (4, "human", False)
    if a in ("attr", "track_attr") and o["attr"] != t["attr"]:
        return 2, "auto", False
    if same:
        return 6, "auto", True
    if a == "trim" and semantic and sorted([[x != 0 for x in o["cut"]], [x != 0 for x in t["cut"]]]) == [[False, True], [True, False]]:
        return 11, "note", False
    return 3, "human", False


def merge(base, ours, theirs, semantic=False):
    """(merged timeline, outcome, Counter of classes, stats), or (base, "refused", ...)."""
    lists = edits(base, ours), edits(base, theirs)
    if None in lists:
        return base, "refused", Counter(), (0, 0, 0, 0, 0)
    held, twice, classes, verdicts = (set(), set()), set(), Counter(), set()
    for (i, o), (j, t) in product(enumerate(lists[0]), enumerate(lists[1])):
        if meets(o, t):
            c, v, once = judge(o, t, semantic)
            classes[c] += 1
            verdicts.add(v)
            if v == "human":
                held[0].add(i), held[1].add(j)
            elif v == "auto" and once:
                twice.add(j)
    twice -= held[1]
    run = [(n, e) for n in (0, 1) for i, e in enumerate(lists[n]) if i not in held[n] and not (n and i in twice)]
    of = lambda *kinds: [(n, e) for n, e in run if e["kind"] in kinds]
    off = {e["bt"] for _, e in of("track_remove")}
    removed, moved = {e["b"] for _, e in of("remove")}, {e["b"]: (n, e) for n, e in of("move")}
    items = {}
    for b in places(base):
        x = dict(at(base, b))
        x["marks"] = list(x["marks"])
        for n, e in run:
            if e.get("b") != b or b in removed:
                continue
            if e["kind"] == "trim" and x["start"] is not None:
                if x["dur"] - sum(e["cut"]) > 0:
                    x["start"], x["dur"] = x["start"] + e["cut"][0], x["dur"] - sum(e["cut"])
                elif b[0] not in off or b in moved:
                    classes[10] += 1
                    verdicts.add("note")
            elif e["kind"] == "attr" and e["attr"] == "range":
                x["start"], x["dur"] = e["value"] or (None, None)
            elif e["kind"] == "attr" and not (e["attr"] == "media" and x["url"] is None):
                x["url" if e["attr"] == "media" else e["attr"]] = e["value"]
            elif e["kind"] == "marker_remove":
                x["marks"] = [m for m in x["marks"] if m[0] != e["mark"][0]]
            elif e["kind"] == "marker_add" and e["mark"][0] not in [m for m, _ in x["marks"]]:
                x["marks"].append(e["mark"])
        items[b] = x
    land = [((0, n, e["s"]), e, e["item"]) for n, e in of("insert")] + [((1, n, e["s"]), e, items[b]) for b, (n, e) in moved.items() if b not in removed]
    land.sort(key=lambda x: x[0])
    last = len(base["tracks"]) - 1
    tracks = []
    for t, track in enumerate(base["tracks"]):
        if t in off:
            continue
        left = [i for i in range(len(track["items"])) if (t, i) not in removed and (t, i) not in moved]
        into = {i: ([], []) for i in [*left, None]}
        end = []
        for _, e, x in land:
            if e["loc"][0] != "base":
                continue
            lost = e["loc"][1] in off
            if (last if lost else e["loc"][1]) != t:
                continue
            if lost or e["slot"][0] != "before":
                end.append(x)
            else:
                i = next((i for i in left if i >= e["slot"][2]), None)
                into[i][i != e["slot"][2]].append((e["slot"][2], x))
        new = []
        for i in [*left, None]:
            exact, later = into[i]
            new += [x for _, x in exact] + [x for _, x in sorted(later, key=lambda p: p[0])]
            new += [items[t, i]] if i is not None else end
        attrs = {e["attr"]: e["value"] for _, e in of("track_attr") if e["bt"] == t}
        tracks.append((t, {**track, **attrs, "items": new}))
    for order in [e["order"] for _, e in of("track_reorder")][-1:]:
        tracks.sort(key=lambda p: (order.index(p[0]) if p[0] in order else len(order) + p[0]))
    tracks = [track for _, track in tracks]
    for n in (0, 1):
        for _, e in [(m, e) for m, e in of("track_add") if m == n]:
            mine = [(x[0][2][1], x[2]) for x in land if x[0][1] == n and x[1]["loc"] == ("new", e["at"][0])]
            tracks.append({**e["track"], "items": [x for _, x in sorted(mine, key=lambda p: p[0])]})
    fields = {}
    for f in ("name", "start"):
        b, o, t = base[f], ours[f], theirs[f]
        clash = o != b and t != b and o != t
        classes[3] += clash
        verdicts |= {"human"} if clash else set()
        fields[f] = b if clash else o if o != b else t
    outcome = "conflicts" if "human" in verdicts else "notes" if "note" in verdicts else "clean"
    stats = len(lists[0]), len(lists[1]), len(run), len(held[0]) + len(held[1]), len(twice)
    return {**fields, "tracks": tracks}, outcome, classes, stats
