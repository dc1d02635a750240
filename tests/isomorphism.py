"""Graph comparison up to blank-node labels, for tests."""

import hashlib

from graphloom.plans.rdf import BNode, nt, parse_ntriples


def canonical(triples) -> list[str]:
    triples = set(triples)
    nodes = {t.label for triple in triples for t in triple if isinstance(t, BNode)}
    colour = dict.fromkeys(nodes, "")
    for _ in range(len(nodes).bit_length() + 6):
        new = {}
        for b in nodes:
            around = sorted(repr([("self" if t.label == b else colour[t.label]) if isinstance(t, BNode) else nt(t) for t in triple]) for triple in triples if any(isinstance(t, BNode) and t.label == b for t in triple))
            new[b] = hashlib.md5(repr(around).encode()).hexdigest()
        colour = new
    return sorted(" ".join(f"_:{colour[t.label]}" if isinstance(t, BNode) else nt(t) for t in triple) for triple in triples)


def same(frame, expected: str) -> None:
    """Assert that a DataFrame of triples is the graph of N-Triples text."""
    got = parse_ntriples("\n".join(" ".join(r) + " ." for r in frame.distinct().collect()))
    assert canonical(got) == canonical(parse_ntriples(expected))
