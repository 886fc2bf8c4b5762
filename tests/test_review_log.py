"""Replay of random command sequences against a plain sequential one."""

import json
import random

import pytest

from provenir.operators.review_log import replay

ENTITY = "id string, name string, extractor string, status string, aliases array<string>, pinned boolean, merged_into string, evidence array<string>, confidence double"
RELATION = "id string, source string, relation string, target string, status string, evidence array<string>, confidence double, extractor string, valid_from string, valid_to string, observed_at string"
COMMAND = "seq long, kind string, action string, id string, text string, other string, moved array<string>, valid_from string, valid_to string, undone_seq long"


def uniq(*lists):
    return list(dict.fromkeys(x for v in lists for x in v))


class Plain:
    """All commands one after another on two dictionaries."""

    def __init__(self, entities, relations):
        self.e, self.r, self.log, self.undone, self.refused = entities, relations, {}, set(), set()

    def put(self, table, new, gone=()):
        for k in gone:
            table.pop(k, None)
        for x in new:
            table[x["id"]] = x

    def do(self, c):
        ok = self.undo(c) if c["action"] == "undo" else self.entity(c) if c["kind"] == "entity" else self.relation(c)
        if not ok:
            self.refused.add(c["seq"])

    def undo(self, c):
        back = self.log.get(c["undone_seq"])
        if back is None or c["undone_seq"] in self.undone:
            return False
        self.undone.add(c["undone_seq"])
        back()
        return True

    def entity(self, c):
        x = self.e.get(c["id"])
        if x is None:
            return False
        status = {"accept": "accepted", "reject": "rejected", "reopen": "pending"}.get(c["action"])
        name = (c["text"] or "").strip()
        back = lambda: self.put(self.e, [x])
        if status:
            new = [x | {"status": status}]
        elif c["action"] in ("pin", "unpin"):
            new = [x | {"pinned": c["action"] == "pin"}]
        elif c["action"] == "rename":
            if not name:
                return False
            new = [x | {"name": name, "aliases": uniq(x["aliases"], [x["name"]])}]
        elif c["action"] == "split":
            moved = [m for m in uniq(c["moved"]) if m in x["evidence"]]
            if not moved or len(moved) == len(x["evidence"]) or not name or c["other"] in self.e:
                return False
            new = [x | {"evidence": [m for m in x["evidence"] if m not in moved]}, x | {"id": c["other"], "name": name, "aliases": [], "evidence": moved, "status": "pending", "pinned": False, "merged_into": None}]
            back = lambda: self.put(self.e, [x], [c["other"]])
        else:
            y = self.e.get(c["other"])
            if y is None or c["id"] == c["other"]:
                return False
            new = [x | {"aliases": uniq(x["aliases"], [y["name"]], y["aliases"]), "evidence": uniq(x["evidence"], y["evidence"]), "confidence": max(x["confidence"], y["confidence"])}, y | {"merged_into": x["id"], "status": "rejected"}]
            affected = [r for _, r in sorted(self.r.items()) if y["id"] in (r["source"], r["target"])]
            rest = {k: r for k, r in self.r.items() if r not in affected}
            made, met = {}, []
            for r in affected:
                s, t = (x["id"] if r[k] == y["id"] else r[k] for k in ("source", "target"))
                if s == t:
                    continue
                k = f"{s}::{r['relation']}::{t}"
                z, old = r | {"id": k, "source": s, "target": t}, made.get(k) or rest.get(k)
                if k in rest and rest[k] not in met:
                    met.append(rest[k])
                if old:
                    z = old | {
                        "evidence": uniq(old["evidence"], z["evidence"]), "confidence": max(old["confidence"], z["confidence"]), "extractor": old["extractor"] if old["extractor"] == z["extractor"] else "merge-reconciled",
                        "status": old["status"] if old["status"] == z["status"] else "pending", "observed_at": min(old["observed_at"], z["observed_at"]),
                        **{f: old[f] if old[f] == z[f] else None for f in ("valid_from", "valid_to")},
                    }
                made[k] = z
            self.put(self.r, made.values(), [r["id"] for r in affected])

            def back():
                self.put(self.e, [x, y])
                self.put(self.r, affected + met, list(made))

        self.put(self.e, new)
        self.log[c["seq"]] = back
        return True

    def relation(self, c):
        r = self.r.get(c["id"])
        if r is None:
            return False
        if c["action"] == "validity":
            f, t = ((v or "").strip() or None for v in (c["valid_from"], c["valid_to"]))
            if "x" in (f or "") + (t or "") or f and t and f > t:
                return False
            new = r | {"valid_from": f, "valid_to": t}
        else:
            new = r | {"status": {"accept": "accepted", "reject": "rejected", "reopen": "pending"}[c["action"]]}
            ends = [self.e.get(r[k]) for k in ("source", "target")]
            if c["action"] == "accept" and (not r["evidence"] or any(x is None or x["status"] != "accepted" or x["merged_into"] for x in ends)):
                return False
        self.put(self.r, [new])
        self.log[c["seq"]] = lambda: self.put(self.r, [r])
        return True


def case(seed, n=120):
    rnd = random.Random(seed)
    ids = [f"e{i}" for i in range(12)]
    entities = {i: {"id": i, "name": f"Name {i}", "extractor": "v1", "status": rnd.choice(["accepted", "accepted", "pending"]), "aliases": [f"a{i}"], "pinned": False, "merged_into": None, "evidence": [f"b{k}" for k in range(rnd.randint(0, 4))], "confidence": rnd.random()} for i in ids}
    relations = {}
    for _ in range(20):
        s, t = rnd.sample(ids, 2)
        k = rnd.choice(["uses", "part-of"])
        relations[f"{s}::{k}::{t}"] = {"id": f"{s}::{k}::{t}", "source": s, "relation": k, "target": t, "status": rnd.choice(["pending", "accepted"]), "evidence": rnd.choice([[], ["x"], ["x", s]]), "confidence": rnd.random(), "extractor": rnd.choice(["v1", "v2"]), "valid_from": rnd.choice([None, "2001-01-01"]), "valid_to": None, "observed_at": rnd.choice(["2003", "2004"])}
    commands = []
    for seq in range(n):
        c = dict.fromkeys(["seq", "kind", "action", "id", "text", "other", "moved", "valid_from", "valid_to", "undone_seq"]) | {"seq": seq * 3, "moved": []}
        roll = rnd.random()
        if roll < 0.25:
            c |= {"action": "undo", "undone_seq": 10_000 if rnd.random() < 0.1 else rnd.randrange(0, seq * 3 + 6, 3)}
        elif roll < 0.65:
            c |= {"kind": "entity", "id": rnd.choice([*ids, "e99", "n3", "n30"]), "action": rnd.choice(["accept", "accept", "reject", "reopen", "rename", "pin", "unpin", "merge", "split"]), "text": rnd.choice([" New ", "Other", " "])}
            c |= {"other": rnd.choice(ids) if c["action"] == "merge" else rnd.choice([f"n{seq}", "n30"]) if c["action"] == "split" else None, "moved": rnd.sample(["b0", "b1", "b2", "zz"], 2)}
        else:
            s, t = rnd.sample(ids, 2)
            c |= {"kind": "relation", "id": rnd.choice([*relations, f"{s}::uses::{t}"]), "action": rnd.choice(["accept", "accept", "reject", "reopen", "validity"]), "valid_from": rnd.choice([None, "2000-01-01", "x", " 2005-05-05 "]), "valid_to": rnd.choice([None, "2004-01-01"])}
        commands.append(c)
    return entities, relations, commands


def table(spark, rows, schema):
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], schema)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay_is_the_plain_sequence(spark, seed):
    entities, relations, commands = case(seed)
    after, moved, log = replay(table(spark, entities.values(), ENTITY), table(spark, relations.values(), RELATION), table(spark, random.Random(seed).sample(commands, len(commands)), COMMAND))
    plain = Plain(dict(entities), dict(relations))
    for c in commands:
        plain.do(c)
    assert {r.id: r.asDict() for r in after.collect()} == plain.e
    assert {r.id: r.asDict() for r in moved.collect()} == plain.r
    rows = log.collect()
    assert {r.seq for r in rows if r.reason} == plain.refused and {r.seq for r in rows} == {c["seq"] for c in commands}
    assert len(plain.undone) > 3 and len(plain.refused) > 10
    # images are whole: an entity's event begins with what the one before it left
    state = {k: {"extractor": None} | v for k, v in entities.items()}
    for r in sorted((r for r in rows if r.kind == "entity" and not r.reason), key=lambda r: r.seq):
        before, new = json.loads(r.before), json.loads(r.after)
        if r.action != "undo":
            assert all({k: v for k, v in state[b["id"]].items() if v is not None} == {k: v for k, v in b.items() if v is not None} for b in before)
        for b in before:
            state.pop(b["id"], None)
        state.update({x["id"]: x for x in new})
    assert set(state) == set(plain.e)


def test_rename_pin_and_validity_are_undone_and_chained_merges_lead_on(spark):
    entities, relations, _ = case(9)
    base = dict.fromkeys([c.split()[0] for c in COMMAND.split(", ")]) | {"kind": "entity"}
    steps = [{"action": "rename", "id": "e1", "text": "Neu"}, {"action": "pin", "id": "e2"}, {"action": "merge", "id": "e4", "other": "e3"}, {"action": "merge", "id": "e5", "other": "e4"}, {"action": "undo", "undone_seq": 0}, {"action": "undo", "undone_seq": 1}]
    some = next(k for k in relations if not {"e3", "e4"} & set(k.split("::")))
    steps += [{"kind": "relation", "action": "validity", "id": some, "valid_from": "1999-01-01"}, {"action": "undo", "undone_seq": 6}, {"action": "undo", "undone_seq": 6}]
    commands = [base | {"seq": i} | s for i, s in enumerate(steps)]
    after, moved, log = replay(table(spark, entities.values(), ENTITY), table(spark, relations.values(), RELATION), table(spark, commands, COMMAND))
    got = {r.id: r for r in after.collect()}
    assert (got["e1"].name, got["e1"].aliases, got["e2"].pinned) == ("Name e1", ["ae1"], False)
    assert got["e3"].merged_into == "e4" and got["e4"].merged_into == "e5" and set(entities["e3"]["evidence"]) <= set(got["e5"].evidence)
    assert not any({r.source, r.target} & {"e3", "e4"} for r in moved.collect())
    assert [(r.seq, r.reason) for r in log.collect() if r.reason] == [(8, "undone before")]


def test_empty_tables(spark):
    entities, relations, commands = case(4, 10)
    none = lambda s: table(spark, [], s)
    e, r, log = replay(table(spark, entities.values(), ENTITY), table(spark, relations.values(), RELATION), none(COMMAND))
    assert (e.count(), r.count(), log.count()) == (len(entities), len(relations), 0)
    e, r, log = replay(none(ENTITY), none(RELATION), table(spark, commands, COMMAND))
    assert (e.count(), r.count()) == (0, 0) and all(x.reason for x in log.collect())
