"""A small prompt: patterns in, highlighted sentences out. `python -m loomspan.shell FOLDER` reads JSON documents."""

from __future__ import annotations

import sys

from .errors import QueryError
from .functions.text import highlight
from .operators.engine import Engine
from .sources import corpus

HELP = ":help, :exit, :settings, :corpus, :labels [prefix], :more, :display N, or a pattern"


class Shell:
    def __init__(self, engine: Engine, display: int = 10, out=print):
        self.e, self.display, self.out = engine, display, out
        self.last, self.after = None, None

    def run(self, line: str) -> bool:
        """Handles a line; False ends the session."""
        word, _, rest = line.strip().partition(" ")
        try:
            if word == ":exit":
                return False
            if word == ":help":
                self.out(HELP)
            elif word == ":settings":
                self.out(f"display {self.display}, default field {self.e.default}, fields {', '.join(self.e.fields)}")
            elif word == ":corpus":
                self.out(f"{self.e.docs.count() if self.e.docs is not None else '?'} documents, {self.e.sentences.count()} sentences")
            elif word == ":labels":
                from pyspark.sql import functions as F

                got = self.e.sentences.select(F.explode("edges.label").alias("l")).filter(F.col("l").startswith(rest)).distinct().orderBy("l").limit(50)
                self.out(" ".join(r.l for r in got.collect()))
            elif word == ":display":
                self.display = int(rest)
            elif word == ":more":
                if self.last is not None:
                    self.show()
            elif line.strip():
                self.last, self.after = self.e.compile(line), None
                self.show()
        except (QueryError, ValueError) as error:
            self.out(f"error: {error}")
        return True

    def show(self) -> None:
        found = self.e.query(self.last, limit=self.display, after=self.after).join(self.e.sentences.select("doc_key", "sent_id", "raw"), ["doc_key", "sent_id"]).orderBy("doc_key", "sent_id", "start").collect()
        for r in found:
            self.out(f"{r.doc_id}:{r.sent_id} " + highlight(r.raw, (r.start, r.end), [(c.name, c.s, c.e) for c in r.caps], "console"))
        if found:
            self.after = (found[-1].doc_key, found[-1].sent_id)
        else:
            self.out("no more matches")


def main(folder: str) -> None:
    from .session import local_session

    d = corpus.read_json(local_session(), folder)
    shell = Shell(Engine(corpus.sentences_of(d).cache(), corpus.docs_of(d)))
    while shell.run(input("> ")):
        pass


if __name__ == "__main__":
    main(sys.argv[1])
