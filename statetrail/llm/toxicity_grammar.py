"""A grammar of toxic clauses as a cascade of finite-state transducers.

Words are read as classes. The *negation* transducer marks abuse within the reach of a negation, the
*reported speech* transducer marks what stands behind a verb of saying or between quotation
marks, and the *clause* transducer takes the marked abuse and the targets of a clause together. The
three are composed once into a single table; a clause is one walk through it. Its last state
says what the clause is, and the weights of these kinds are learned.
"""

from __future__ import annotations

import re
from itertools import product

#: Classes of words. Letters other than these, OTHER, only use up the reach of a negation.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, BREAK = range(8)
#: Words behind a negation that it still governs.
REACH = 3
#: Kinds of clauses.
KINDS = ("insult", "insult_target", "insult_negated", "insult_reported",
         "threat", "threat_target", "threat_negated", "threat_reported")

# Closed classes in English, German, French and Spanish.
FIXED_WORDS = {
    THREAT: "kill hurt destroy beat stab shoot burn töten umbringen verletzen zerstören tuer frapper "
            "détruire matar golpear destruir",
    TARGET: "you your yours he she him her they them these those people du dich dir ihr euch sie "
            "tu toi te vous ils elles tú ti usted ustedes ellos ellas",
    NEGATION: "not no never neither nor nicht kein keine niemals nie pas jamais aucun aucune "
              "nunca ningún ninguna",
    REPORT: "said says say called calls wrote writes claimed quoted sagte sagt nannte schrieb dit disait "
            "écrit appelle dijo dice llamó escribió",
    INSULT: "idiot moron stupid loser scum trash worthless pathetic disgusting dumb fool jerk "
            "dummkopf trottel blöd abschaum crétin imbécile débile ordure estúpido imbécil basura",
}

TOKEN = re.compile(r"[^\W\d_]+|[.!?;:,\n]|[\"“”„«»]")
_BREAKS, _QUOTES = frozenset(".!?;:,\n"), frozenset("\"“”„«»")


class Transducer:
    """Deterministic: ``step[state, symbol]`` is the next state and the symbol put out."""

    def __init__(self, start, step: dict):
        self.start, self.step = start, step

    def then(self, other: Transducer) -> Transducer:
        """Composition: ``other`` reads what this one puts out."""
        step, todo, seen = {}, [(self.start, other.start)], set()
        symbols = {symbol for _, symbol in self.step}
        while todo:
            state = todo.pop()
            if state in seen:
                continue
            seen.add(state)
            for symbol in symbols:
                own, out = self.step[state[0], symbol]
                far, last = other.step[state[1], out]
                step[state, symbol] = (own, far), last
                todo.append((own, far))
        return Transducer((self.start, other.start), step)


def _negation() -> Transducer:
    """Marks abuse as (class, negated); the state is how many words are still governed."""
    step = {}
    for left, symbol in product(range(REACH + 1), range(8)):
        after = REACH if symbol == NEGATION else 0 if symbol == BREAK else max(0, left - 1)
        step[left, symbol] = after, (symbol, left > 0 and symbol in (INSULT, THREAT))
    return Transducer(0, step)


def _reported() -> Transducer:
    """Marks abuse that is reported, quoted or both; a verb of saying holds until the clause ends."""
    step = {}
    for (said, quoted), (symbol, negated) in product(
            product((False, True), repeat=2), product(range(8), (False, True))):
        mark = "negated" if negated else "reported" if said or quoted else ""
        after = (said or symbol == REPORT) and symbol != BREAK, quoted != (symbol == QUOTE)
        step[(said, quoted), (symbol, negated)] = after, (symbol, mark)
    return Transducer((False, False), step)


def _clause() -> Transducer:
    """Puts out the kinds of the clause, as numbers of KINDS, when it ends."""
    step = {}
    kinds = [frozenset(k) for k in product(*[("", m) for m in
             ("insult", "insult_negated", "insult_reported",
              "threat", "threat_negated", "threat_reported")])]
    for (target, found), symbol, mark in product(
            product((False, True), kinds), range(8), ("", "negated", "reported")):
        if symbol == BREAK:
            names = [f"{k}_target" if target and k in ("insult", "threat") else k for k in found if k]
            step[(target, found), (symbol, mark)] = (
                (False, frozenset([""])), tuple(sorted(KINDS.index(n) for n in names)))
            continue
        kind = {INSULT: "insult", THREAT: "threat"}.get(symbol)
        added = found | {f"{kind}_{mark}" if mark else kind} if kind else found
        step[(target, found), (symbol, mark)] = (target or symbol == TARGET, added | {""}), ()
    return Transducer((False, frozenset([""])), _closed(step))


def _closed(step: dict) -> dict:
    """States with and without the empty kind are the same."""
    return {((state[0], state[1] | {""}), symbol): value for (state, symbol), value in step.items()}


def _table() -> list[list[tuple[int, tuple[int, ...]]]]:
    """The composed cascade with numbered states; state 0 is the start."""
    machine = _negation().then(_reported()).then(_clause())
    numbers = {machine.start: 0}
    for state, _ in machine.step:
        numbers.setdefault(state, len(numbers))
    table = [[(0, ())] * 8 for _ in numbers]
    for (state, symbol), (after, out) in machine.step.items():
        table[numbers[state]][symbol] = numbers[after], out
    return table


TABLE = _table()


class Reader:
    """Counts the kinds of clauses in texts; ``learned`` are further insults: words and, with a
    star behind them, beginnings of words."""

    def __init__(self, learned: set[str]):
        self.words = {w: kind for kind, words in FIXED_WORDS.items() for w in words.split()}
        self.words.update((w, INSULT) for w in learned if not w.endswith("*"))
        self.stems = {w[:-1] for w in learned if w.endswith("*")}
        self.lengths = sorted({len(s) for s in self.stems})
        self.seen: dict[str, int] = {}

    def kind(self, word: str) -> int:
        if word in _BREAKS:
            return BREAK
        if word in _QUOTES:
            return QUOTE
        found = self.words.get(word, OTHER)
        if found == OTHER and any(word[:n] in self.stems for n in self.lengths if n <= len(word)):
            return INSULT
        return found

    def counts(self, text: str) -> tuple[list[int], int]:
        """How many clauses there are of each kind, and how many words and marks."""
        words = TOKEN.findall(text.lower())
        seen, out = self.seen, [0] * len(KINDS)
        if len(seen) > 200_000:
            seen.clear()
        for word in set(words).difference(seen):
            seen[word] = self.kind(word)
        kinds = list(map(seen.__getitem__, words))
        if INSULT not in kinds and THREAT not in kinds:
            return out, len(words)
        state = 0
        for kind in (*kinds, BREAK):
            state, ended = TABLE[state][kind]
            for k in ended:
                out[k] += 1
        return out, len(words)
