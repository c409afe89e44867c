"""Fixed word lists and small text helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re

#: Words that carry a sentence rather than a topic (articles, pronouns, prepositions, conjunctions,
#: auxiliaries), by language.
FUNCTION_WORDS = {
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber von zu zum zur im in an am auf bei mit ohne für aus "
    "nach vor über unter durch gegen um als wie ist sind war waren wird werden wurde wurden sein seine sich es er sie wir ihr ihre "
    "nicht kein keine dass weil ob obwohl wenn während bis noch nur auch hat haben hatte hatten was wer sobald damit",
    "en": "the a an and or but of to in on at by for from with without as is are was were be been it its this that these those they "
    "them he she his her we you i not no than so if when while because although though since after before into over under up out "
    "about there their which who what has have had will would can could should may do does did until whether nor",
    "es": "el la los las un una unos unas de del y o pero a al en con sin por para sobre bajo que quien cuando como si no se su sus lo "
    "le les es son era fue ser ha han había más muy ya desde hasta entre ante tras este esta estos aunque porque donde según",
    "fr": "le la les un une des du de d l et ou mais à au aux en dans sur sous par pour avec sans ce cette ces il elle ils elles on "
    "nous vous que qui dont où n ne pas plus est sont était être été a ont avait avant après depuis si comme son sa ses leur leurs s "
    "qu selon jusqu",
    "nl": "de het een en of maar van voor in op aan bij met zonder uit naar over onder door tegen om te als dan is zijn was waren wordt "
    "werd worden niet geen er dat die dit deze hij zij ze wij hun haar zich nog ook al heeft had hadden wat wie toen terwijl omdat "
    "hoewel zodat tot totdat tussen na volgens",
    "pt": "o a os as um uma uns umas de do da dos das e ou mas em no na nos nas com sem por pelo pela para sobre sob que quem quando "
    "como se não seu sua seus suas ao à aos é são era foi ser tem há mais muito já desde até entre antes depois este esta embora "
    "porque onde lhe segundo",
}
FUNCTION_OF = frozenset(w for words in FUNCTION_WORDS.values() for w in words.split())

WORD = re.compile(r"\w+")
URL = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]|]+", re.I)
FENCE = re.compile(r"^\s*(?:```|~~~)")
#: Fixed value: what marks a line outside a fence as program code: a prompt, a call or assignment, a block or a statement end.
CODE = re.compile(r"^\s*(?:\$ |>>> |#include\b|import \w+$|from \w+ import |def \w+\(|class \w+[:(]|return\b.*[;)]|[\w.]+ ?= ?[\w.\[{'\"(]+.*[\])'\"}]$|[\w.]+\(.*\);?$|</?\w+[^>]*>\s*$)")

#: The end of a block or statement, which is code where at least one character in twenty is a mark.
STATEMENT_END = re.compile(r"[{};]\s*$")
SYMBOL = re.compile(r"[^\w\s]")


def code_lines(lines: list[str]) -> list[bool]:
    """Whether each line is program code: between two fences, a fence itself, or of the form of a statement.

    A fence that no other one closes fences nothing, so the lines after it count by their own form.
    """
    fences = [k for k, line in enumerate(lines) if FENCE.match(line)]
    out = [bool(CODE.match(line)) or STATEMENT_END.search(line) is not None and len(SYMBOL.findall(line)) >= 0.05 * len(line) for line in lines]
    for first, last in zip(fences[::2], fences[1::2], strict=False):
        out[first : last + 1] = [True] * (last + 1 - first)
    for k in fences:
        out[k] = True
    return out
