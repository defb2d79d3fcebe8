"""Functions, types, calls and fields of whole texts, found in the arrays of their tokens.

The results are those of `tokens.functions`, `types`, `calls`, `metrics` and `fields`, which
look at a row for each token.  Here a task looks at the tokens of a few texts at a time
(`tokens.PIECE`, at least a text) and hands on what they declare and call; a function
that stands in two owners' bodies is measured once for each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lodegraph.sources import tokens
from lodegraph.sources.tokens import NAME


def matches(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a left join of keys with at: those in keys, again for each match, and the matches or -1."""
    order = np.argsort(at, kind="stable")
    low, high = np.searchsorted(at[order], keys, "left"), np.searchsorted(at[order], keys, "right")
    n = np.maximum(high - low, 1)
    left = np.repeat(np.arange(len(keys)), n)
    nth = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
    hit = (high > low)[left]
    right = np.full(len(left), -1, np.int64)
    right[hit] = order[(low[left] + nth)[hit]]
    return left, right


class Bodies:
    """What the tokens of a table of `tokens._flattened` declare and call, as arrays of their rows."""

    def __init__(self, table: pa.Table):
        own = {c: tokens._flat(table.column(c)) for c in table.column_names}
        self.files, self.number = own["file"], np.asarray(own["number"])
        self.languages = own["language"]
        coded = self.languages.dictionary_encode()
        self._spoken = np.asarray(coded.indices.fill_null(-1)), coded.dictionary.to_pylist()
        s = self.s = tokens.Siblings(self.number, own["at"], own["line"], own["token"])
        self.name = s.like(NAME)
        self.callable = self.name & ~s.is_(*tokens.NOT_CALLED)
        self.brace = (s.stop >= 0) & s.is_("{")[s.stop]
        self._types()
        self._functions()

    def speaks(self, *languages: str) -> np.ndarray:
        codes, names = self._spoken
        return np.array([n in languages for n in names] + [False])[codes]

    def _types(self):
        s = self.s
        lead, impl = s.beside(-1, s.is_(*tokens.TYPE_WORDS)), s.beside(-1, s.is_("impl"))
        plain = self.name & lead & ~impl
        other = (s.side[1] >= 0) & ~s.beside(1, s.is_("for"))
        implemented = self.speaks("rust") & self.name & (impl & other | s.beside(-1, s.is_("for")) & s.beside(1, s.is_("{")))
        self.type_at = np.flatnonzero(self.brace & (plain | implemented))
        self.type_body = s.stop[self.type_at]

    def _functions(self):
        s, at = self.s, np.arange(len(self.number))
        is_, beside = s.is_, s.beside
        announced = beside(-1, is_(*tokens.DECLARE)) | beside(-3, is_("fun")) & beside(-1, is_("."))
        after = np.zeros(len(at), bool)
        for name, allowed in tokens.AFTER.items():
            after |= self.speaks(name) & beside(3, is_(*allowed))
        script, first = self.speaks("typescript", "javascript"), s.side[-1] < 0
        free = np.where(
            script,
            first | beside(-1, is_("", "{", "}", ";", ",", ")", "*", *tokens.MODIFIERS) | s.like("^@")),
            ~beside(-1, is_(".", "->", "new", "return", "throw", "else", "=", "(", ",", "?")),
        )
        unannounced = beside(1, is_("(")) & beside(2, is_(")")) & after & free & ~announced
        named = np.flatnonzero(self.brace & (self.name & announced | self.callable & unannounced))
        arrows = np.flatnonzero(script & self.brace & is_("=>") & beside(1, is_("{")) & s.arrow & self.name[s.given])
        found = np.r_[named, arrows]
        parens = np.r_[s.paren[named], s.back[arrows]]
        left, owner = matches(np.where(s.block[found] >= 0, s.block[found], -2), self.type_body)
        found, parens = found[left], parens[left]
        self.fn_at = np.r_[named, s.given[arrows]][left]
        self.fn_owner = np.where(owner >= 0, self.type_at[np.maximum(owner, 0)], -1) if len(self.type_at) else owner
        self.fn_commas = s.comma_counts(parens)
        self.fn_body = s.stop[found]
        self.fn_end = s.side[1][self.fn_body]
        # The innermost body around a token; its brackets lie outside: its end comes before the token there, its begin behind.
        begin, end = np.unique(self.fn_body), np.unique(self.fn_end[self.fn_end >= 0])
        key = np.r_[at * 3 + 1, begin * 3 + 2, end * 3]
        side = np.repeat([0, 1, -1], [len(at), len(begin), len(end)])
        order = np.argsort(key, kind="stable")
        key, side = key[order] // 3, side[order]
        inner = tokens._innermost(side == 1, side == -1, self.number[key])
        self.body = np.where(inner >= 0, key[inner], -1)[side == 0]

    def text(self, rows: np.ndarray) -> pa.Array:
        """The tokens of rows, null where they are negative."""
        return tokens._picked(self.s.token, rows)

    def calls(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the calls' names, and those of their receivers or -1."""
        s = self.s
        at = np.flatnonzero(s.beside(1, s.is_("(")) & self.callable & ~s.beside(-1, s.is_(*tokens.DECLARE, "new")))
        dotted = s.beside(-1, s.is_(".", "::", "?.", "->"))[at]
        return at, np.where(dotted, s.side[-2][at], -1)

    def metrics(self) -> dict:
        """The columns of `tokens.metrics` for every function."""
        s, is_, beside = self.s, self.s.is_, self.s.beside
        begin = np.unique(self.fn_body)
        inside = np.flatnonzero((self.body >= 0) & (is_(";", "?", "{", *tokens.CONTROL, *tokens.DECISIONS) | beside(1, is_("("))))
        n, of = len(begin), np.searchsorted(begin, self.body[inside])
        at = lambda marked: marked[inside]
        tail = at(is_("while") & beside(3, is_(";")) & beside(-1, is_("}")))
        braces = at((s.block < 0) | is_("{")[s.block])
        in_body = braces & ~tail
        ternary = at(is_("?") & ~beside(1, is_(":", ">", ",", ")", "=")))
        control = at(is_(*(w for w in tokens.CONTROL if w not in tokens.FOLLOW))) & in_body
        loop, called = at(is_(*tokens.LOOPS)) & in_body, at(beside(1, is_("(")) & self.callable)
        bare = at(~beside(-1, is_(".", "?.", "->", "::")) | beside(-2, is_("this", "self", "Self", "cls")))
        base = begin[of]
        in_loop = called & (at(s.loop_depth) > s.loop_depth[base])
        count = lambda marked: np.bincount(of[marked], minlength=n)

        def deepest(marked, depth):
            most = np.zeros(n, np.int64)
            np.maximum.at(most, of[marked], (at(depth) - depth[base] + 1)[marked])
            return most

        def words(listed):
            kept, found = in_loop & at(s.like(rf"^({'|'.join(listed)})$", lower=True)), {}
            for i, word in zip(of[kept].tolist(), self.text(inside[kept]).to_pylist()):
                found.setdefault(i, set()).add(word)
            return found

        mine = np.searchsorted(begin, self.fn_body)
        scans, sorts = words(tokens.SCAN_CALLS), words(tokens.SORT_CALLS)
        listed = lambda found: pa.array([sorted(found.get(i, ())) for i in mine.tolist()], pa.list_(pa.string()))
        # Calls of a name within its own body: by function, for two names may share a body.
        heads = set(zip(mine.tolist(), s.codes[self.fn_at].tolist()))
        plain = called & bare
        itself = {p for p in zip(of[plain].tolist(), s.codes[inside[plain]].tolist()) if p in heads}
        whole = lambda values: pa.array(values[mine], pa.int64())
        return {
            "statements": whole(count(at(is_(";")) & in_body | control)),
            "decisions": whole(1 + count(at(is_(*tokens.DECISIONS)) & ~tail | ternary)),
            "nesting": whole(deepest(control, s.control_depth)), "loop_nesting": whole(deepest(loop, s.loop_depth)),
            "loops": whole(count(loop)), "loop_scans": listed(scans), "loop_sorts": listed(sorts),
            "recursive": pa.array([p in itself for p in zip(mine.tolist(), s.codes[self.fn_at].tolist())], pa.bool_()),
        }

    def fields(self) -> list[tuple[int, int, str]]:
        """Type row, name row and type text of the data members that types declare."""
        s, is_ = self.s, self.s.is_
        if not len(self.type_at):
            return []
        order, group, found = s.order, s.group, []
        bodies = np.zeros(len(order), bool)
        bodies[self.type_body] = True
        inside = ((s.block >= 0) & bodies[s.block])[order]
        first = s.side[-1] < 0
        before = lambda *words: s.beside(-1, is_(*words))
        colon, rust = self.speaks("typescript", "javascript", "kotlin", "rust", "python"), self.speaks("rust")
        opening = first | before("", ";", "{", "}", ",", ")", "val", "var", "let", "const", "pub", "lateinit", "static", "declare", *tokens.MODIFIERS)
        named = (colon & self.name & s.beside(1, is_(":")) & (opening | s.beside(-1, s.like("^@"))))[order] & inside
        # A type text goes from the colon to the end of its declaration or line.
        field = tokens._latest(named, group, itself=True)
        stop = tokens._latest((is_(";", "=", "{", "}", "(") | is_(",") & rust)[order], group, itself=True)
        at, line = np.asarray(s.at)[order].astype(np.int64), np.asarray(s.line.fill_null(-1))[order]
        mine = np.maximum(field, 0)
        typed = np.flatnonzero(inside & (field >= 0) & (at > at[mine] + 1) & (line == line[mine]) & (stop < field))
        text = s.token.take(pa.array(order[typed])).to_pylist()
        cuts = np.flatnonzero(np.r_[True, np.diff(field[typed]) != 0]) if len(typed) else np.zeros(0, np.int64)
        for i, j, p in zip(cuts.tolist(), np.r_[cuts[1:], len(typed)].tolist(), field[typed][cuts].tolist()):
            found.append((order[p], "".join(text[i:j])))
        # 'Type name' ends a run of words that no bracket but those of types interrupts.
        start = tokens._latest(is_(";", "{", "}")[order], group)
        ended = tokens._latest(is_("=", "(", ")")[order], group)
        typed = s.beside(-1, self.name) & ~before(*tokens.TYPE_WORDS, *tokens.MODIFIERS, "return") | before(">", "]", "?", "*")
        declared = np.flatnonzero(inside & (ended <= start) & (~colon & self.name & s.beside(1, is_(";", "=", "{")) & typed)[order])
        kept = np.flatnonzero((~is_(*tokens.MODIFIERS, "volatile", "transient", "const", "mutable") & ~s.like("^@"))[order])
        text = s.token.take(pa.array(order[kept])).to_pylist()
        # Without a bracket or end before it, a run begins with its block.
        opened = np.flatnonzero(np.r_[True, np.diff(group) != 0])
        head = np.where(start >= 0, start + 1, np.repeat(opened, np.diff(np.r_[opened, len(group)])))
        low, high = np.searchsorted(kept, head[declared]), np.searchsorted(kept, declared)
        found += [(order[p], "".join(text[i:j])) for p, i, j in zip(declared.tolist(), low.tolist(), high.tolist()) if i < j]
        rows = np.array([r for r, _ in found], np.int64)
        left, owner = matches(s.block[rows], self.type_body)
        return [(int(self.type_at[o]), int(rows[i]), found[i][1]) for i, o in zip(left.tolist(), owner.tolist())]


METRICS = (
    "file string, language string, owner string, name string, line long, parameters long, body_at int, body_end int, end_line long, lines long, "
    "statements long, decisions long, nesting long, loop_nesting long, loops long, loop_scans array<string>, loop_sorts array<string>, recursive boolean"
)


def _measured(batches):
    for table in tokens._flattened(batches):
        b = Bodies(table)
        s, at = b.s, b.fn_at
        if not len(at):
            continue
        line, end = tokens._picked(s.line, at), tokens._picked(s.line, b.fn_end)
        yield from pa.table({
            "file": tokens._picked(b.files, b.fn_body), "language": tokens._picked(b.languages, b.fn_body),
            "owner": b.text(b.fn_owner).fill_null(""), "name": b.text(at), "line": line,
            "parameters": pc.add(b.fn_commas, 1).fill_null(0), "body_at": tokens._picked(s.at, b.fn_body), "body_end": tokens._picked(s.at, b.fn_end),
            "end_line": end, "lines": pc.add(pc.subtract(end, line), 1), **b.metrics(),
        }).to_batches(10_000)


def metrics(texts: DataFrame) -> DataFrame:
    """tokens.metrics() of the functions in texts (file, language, content), one row for each function."""
    return tokens.tokenised(texts).mapInArrow(_measured, METRICS)
