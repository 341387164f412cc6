"""System catalogs as XML."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from ..plans.catalog import Field, Relation, System, TrustCondition
from ..plans.rules import Atom, Tgd, parse_tgd


def _flag(e: ET.Element, name: str, default: bool) -> bool:
    return e.get(name, str(default)).lower() == "true"


def loads(text: str) -> System:
    """Peers with schemas and relations, mappings, and trust conditions."""
    root = ET.fromstring(text)
    system = System(root.get("name", ""))
    for peer in root.iter("peer"):
        for schema in peer.iter("schema"):
            for rel in schema.iter("relation"):
                keys = {(n.get("name") or (n.text or "")).strip() for pk in rel.findall("primaryKey") for n in pk.findall("fieldName")}
                fields = tuple(Field(f.get("name"), f.get("type"), _flag(f, "key", False) or f.get("name") in keys, _flag(f, "nullable", True), _flag(f, "labeledNullable", True)) for f in (rel.findall("field") or rel.findall("dbinfo/field")))
                system.add(Relation(peer.get("name"), schema.get("name"), rel.get("name"), fields))
    for m in root.iter("mapping"):
        heads = [a.text.strip() for a in m.findall("head/atom")]
        body = [a.text.strip() for a in m.findall("body/atom")]
        tgd = parse_tgd(f"{', '.join(heads)} :- {', '.join(body)}", m.get("name", ""))
        deletable = {i for i, a in enumerate(m.findall("body/atom")) if _flag(a, "del", False)}
        atoms = tuple(Atom(a.relation, a.args, a.negated, i in deletable) if isinstance(a, Atom) else a for i, a in enumerate(tgd.body))
        trust = m.get("trustRank")
        system.mappings.append(Tgd(tgd.heads, atoms, tgd.name, _flag(m, "bidirectional", False), int(trust) if trust else None))
        if not _flag(m, "materialized", True):
            system.virtual |= {h.relation for h in tgd.heads}
    for conditions in root.iter("trustConditions"):
        for t in conditions.iter("trusts"):
            system.trust.append(TrustCondition(conditions.get("peer"), t.get("relation") or f"{t.get('pid')}.{t.get('schema')}.{t.get('relation')}", t.get("pid"), int(t.get("priority")), (t.findtext("predicate") or "").strip() or None))
    return system


def dumps(system: System) -> str:
    """The catalog of a system; :func:`loads` gives an equal one."""
    root = ET.Element("catalog", name=system.name)
    for peer in system.peers():
        p = ET.SubElement(root, "peer", name=peer)
        for schema in sorted({r.schema for r in system.relations.values() if r.peer == peer}):
            s = ET.SubElement(p, "schema", name=schema)
            for r in system.relations.values():
                if (r.peer, r.schema) == (peer, schema):
                    e = ET.SubElement(s, "relation", name=r.name)
                    for f in r.fields:
                        ET.SubElement(e, "field", name=f.name, type=f.type, key=str(f.key).lower(), nullable=str(f.nullable).lower(), labeledNullable=str(f.labeled).lower())
    for m in system.mappings:
        virtual = any(h.relation in system.virtual for h in m.heads)
        e = ET.SubElement(root, "mapping", name=m.name, bidirectional=str(m.bidirectional).lower(), materialized=str(not virtual).lower(), **({"trustRank": str(m.trust)} if m.trust is not None else {}))
        for part, atoms in (("head", m.heads), ("body", m.body)):
            sub = ET.SubElement(e, part)
            for a in atoms:
                atom = ET.SubElement(sub, "atom", **({"del": "true"} if isinstance(a, Atom) and a.deletable else {}))
                atom.text = str(a)
    for peer in sorted({t.peer for t in system.trust}):
        e = ET.SubElement(root, "trustConditions", peer=peer)
        for t in system.trust:
            if t.peer == peer:
                own = ET.SubElement(e, "trusts", pid=t.origin, relation=t.relation, priority=str(t.priority))
                if t.predicate:
                    ET.SubElement(own, "predicate").text = t.predicate
    return ET.tostring(root, encoding="unicode")
