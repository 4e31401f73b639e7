"""Vocabulary IRIs, in one place. Operators take a Vocabulary, so short names serve as well as full IRIs."""

from __future__ import annotations

from dataclasses import dataclass

FULL = {
    "rdf:": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs:": "http://www.w3.org/2000/01/rdf-schema#",
    "owl:": "http://www.w3.org/2002/07/owl#",
}


@dataclass(frozen=True)
class Vocabulary:
    """Maps a short name such as `owl:Class` to the IRI that the triples hold."""

    short: bool = False

    def __call__(self, *names: str) -> list[str]:
        return [self.one(n) for n in names]

    def one(self, name: str) -> str:
        prefix = name[: name.index(":") + 1]
        return name if self.short else FULL[prefix] + name[len(prefix) :]


IRIS = Vocabulary()
SHORT = Vocabulary(short=True)
