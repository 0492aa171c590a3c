"""Problem 1: answers that are no sound answer to their question.

An answer is freed of tags, placeholders and bare frames and cut into clauses,
and a linear-chain conditional random field tags each as answer, refusal, echo,
foreign or unfinished. Its features are general (overlap with the question,
language against the question's, how the clause ends, what is left open, who
speaks, what is denied, whether the clause speaks of a topic at all or only of
asking, knowing and the given text), and it is trained here, on clause sequences
that a small grammar of its own writes with their tags. What each tag covers of
the text then gives the defect:

- empty: nothing is covered, as no clause is left
- language: the foreign part is larger than all others
- truncated: the unfinished part reaches the end
- refusal: the answered part is empty, and some is refused
- copy: the answered part is empty, and some is echoed

The model is a few thousand numbers and goes to every task; the work is per
row. Defined results: a null answer is empty; a null or blank question has no
language and nothing to echo; a repeated load of a record counts once.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholaspark.llm.common import WORD, bounded_rows, table
from scholaspark.operators.documents import first_loads

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
SEED = 11
EXAMPLES = 2400
ROUNDS = 160

#: What stands for no answer, and words that only frame one.
PLACEHOLDERS = {"none", "null", "nil", "nan", "n a", "na", "no answer", "not available", "not applicable", "empty", "blank", "tbd", "todo", "undefined", "missing", "unknown", "placeholder"}
FRAMES = {"answer", "the answer", "the answer is", "response", "reply", "a", "final answer", "assistant", "output", "result", "antwort", "réponse", "respuesta", "答案", "回答"}
ECHO_FRAMES = ("you asked", "the question is", "question", "q", "your question", "i was asked", "the user asks", "frage", "die frage", "la question", "pregunta", "la pregunta", "asked")

_ECHO_STARTS = tuple(f + " " for f in ECHO_FRAMES if len(f) > 1)
_FRAMED = {f"{f} {p}" for f in FRAMES for p in PLACEHOLDERS}

_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_CLAUSE = re.compile(r"(?<=[.!?:…])[\"”»')\]]*\s+|(?<=[。！？；：])|\n+")
_CITATION = re.compile(r"(?:\s*(?:\[\d+(?:, ?\d+)*\]|\((?:see|cf\.?|Table|Figure|Section|siehe|voir|véase)\b[^()]*\)))+\s*$")
_ITEM = re.compile(r"^\s*(?:\(?\d+[.)]|\(?[a-z]\)|[-*•–])\s+")
_NUMBERS = {w: i + 2 for i, ws in enumerate(("two zwei deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf cinq cinco", "six sechs six seis", "seven sieben sept siete")) for w in ws.split()}
_SPEAKER = set("i me my i'm i've i'd i'll myself we'd ich mir mich mein meine meiner meines je j'ai moi me mon ma mes yo mi mis".split())
_DENIAL = set("not no cannot can't unable won't don't couldn't isn't doesn't didn't wouldn't nothing none nowhere neither without silent outside beyond decline refuse rather open lack lacks missing absent insufficient impossible nicht kein keine keinen nichts ne n'ai pas rien aucune aucun nada ninguna ningún imposible".split())
_ABILITY = set("answer help know say comment speculate respond discuss decline guess access possible able information determine provide assist judge tell infer beantworten wissen weiß sagen antworten helfen répondre sais dire aider responder sé decir ayudar".split())
_SORRY = set("sorry apologies apologise apologize unfortunately regret afraid leider désolé malheureusement siento lamentablemente".split())
_CONTEXT = set("context passage passages source sources material document documents excerpt excerpts information text mentioned paper provided supplied given retrieved available request question kontext text quellen unterlagen contexte texte documents contexto texto fuentes".split())
_KNOWING = set("know known knowledge idea clue certain sure aware unknown unclear uncertain answer view opinion ahnung weiß wissen idée sais idea sé".split())
_RULE = set("guidelines guideline policy policies rules instructions permission permitted allowed allow allows forbid forbids forbidden prohibit prohibits prohibited restricted comply prevent prevents follow regeln erlaubt dürfen darf règles permis autorisé reglas permitido".split())
_TELLING = set("address addresses cover covers mention mentions mentioned discuss discusses contain contains state states stated say says tell tells explain explains answers answering reply replying respond responding comment support supports specify specified found inferred determined described statement scope remit help".split())
_THIS = set("this that it here these those question request das dies diese dazu darauf cela ça cette esto eso esta".split())
_COURTESY = {"please", "hope", "understand", "anything", "else", "consult", "instead", "thank", "thanks", "asking", "bitte", "merci", "gracias"}
#: Words that name no topic, beside the common ones.
_TOPICLESS = _SPEAKER | _DENIAL | _ABILITY | _SORRY | _CONTEXT | _KNOWING | _RULE | _TELLING | _THIS | _COURTESY | set("am is are was were be been being do does did have has had will would can could may might must should shall about any some enough too little more than there what which how why from of to on in for with at the a an or and if so but you your me one only just all possible made make give lies falls seems topic matter subject anything something".split())
_OPENERS = ("as a language model", "based on the", "after reading", "as an ai", "hm", "well")
_HANGING = set("the a an of and or to in on with by for from that which its their is are was were be as at but not nor than if when while because into between each every this these those and der die das den dem ein eine und oder mit von für bei zu auf le la les un une et ou de des du dans sur avec par pour que qui el los las y o en con por del se whose it they where has have had no any some such".split())


_HAN = re.compile("[一-鿿]")


@lru_cache(maxsize=1)
def _letters() -> dict[str, str]:
    return {"ß": "de", "ä": "de", "ö": "de", "ü": "de", "ñ": "es", "¿": "es", "¡": "es", "ó": "es", "í": "es", "ç": "fr", "è": "fr", "ê": "fr", "à": "fr", "œ": "fr", "ô": "fr"}


def language(text: str, common: dict[str, tuple[str, ...]]) -> str | None:
    """The language that most of the text's common words point to, or None."""
    votes: dict[str, float] = {}
    lower = text.lower()
    if not lower.isascii():
        han = len(_HAN.findall(text))
        if han >= 6 or (han and han * 3 > sum(map(str.isalpha, text))):
            return "zh"
        for ch, lang in _letters().items():
            if ch in lower:
                votes[lang] = votes.get(lang, 0.0) + 0.5
    for word in WORD.findall(lower):
        for lang in (at := common.get(word, ())):
            votes[lang] = votes.get(lang, 0.0) + 1.0 / len(at)
    if not votes:
        return None
    best = max(sorted(votes), key=votes.get)
    rest = max((v for k, v in votes.items() if k != best), default=0.0)
    return best if votes[best] >= 0.9 and votes[best] > rest else None


def bare(text: str | None) -> str:
    """What a text says, without tags, frames, signs and case."""
    words = WORD.findall(_TAG.sub(" ", text or "").lower())
    return " ".join(words)


def said(answer: str | None) -> str:
    """What an answer says: without tags, and nothing where only a placeholder
    or a frame is left."""
    text = _TAG.sub(" ", answer or "")
    plain = bare(text)
    if plain in PLACEHOLDERS or plain in FRAMES or plain in _FRAMED:
        return ""
    return text


def clauses(text: str) -> list[str]:
    return [x.strip() for x in _CLAUSE.split(text) if x and x.strip() and (any(map(str.isalnum, x)) or "```" in x)]


def _places(words: list[str]) -> tuple[dict[str, int], int]:
    """Of each word the bits of its places, and the number of words."""
    at: dict[str, int] = {}
    for i, w in enumerate(words):
        at[w] = at.get(w, 0) | 1 << i
    return at, len(words)


def _overlap(words: list[str], places: tuple[dict[str, int], int]) -> int:
    """Length of the longest common subsequence of words, a bit per place."""
    at, size = places
    full = row = (1 << size) - 1
    for w in words:
        hit = row & at.get(w, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def _left_open(text: str) -> bool:
    """A bracket, quotation or code block that isn't closed."""
    plain = _ITEM.sub("", text)
    plain = re.sub(r"(?m)^\s*\(?\w{1,2}\)", "", plain)
    return plain.count("(") > plain.count(")") or plain.count("[") > plain.count("]") or plain.count("“") > plain.count("”") or text.count("```") % 2 == 1 or plain.count("{") > plain.count("}")


FEATURES = (
    "bias", "echo_all", "echo_most", "echo_some", "covers_question", "echo_frame", "same_language", "other_language", "no_language",
    "ends_full", "ends_cited", "ends_bare", "ends_ellipsis", "ends_half", "ends_short", "hanging", "left_open", "last", "only", "last_bare_after_full", "last_item_bare", "last_item_half", "promised_more", "one_word_cut",
    "speaker", "denial", "ability", "sorry", "context", "courtesy", "opener", "speaker_denial", "denial_ability", "denial_context", "speaker_ability", "third_person", "long", "short", "item", "name_only", "after_answer",
    "knowing", "rule", "telling", "topicless", "one_topic", "speaker_knowing", "speaker_rule", "denial_telling", "denial_this", "topicless_denial", "topicless_rule", "one_topic_denial_context", "only_hanging", "topicless_other_language",
)
_AT = {f: i for i, f in enumerate(FEATURES)}


def features(question: str | None, answer: str | None, common: dict[str, tuple[str, ...]]) -> tuple[list[str], np.ndarray]:
    """The clauses of an answer and a row of 0/1 features for each."""
    parts = clauses(said(answer))
    rows = np.zeros((len(parts), len(FEATURES)))
    asked = WORD.findall((question or "").lower())
    places = _places(asked)
    asked_set = set(asked)
    asked_language = language(question or "", common)
    items = [i for i, p in enumerate(parts) if _ITEM.match(p)]
    promised = 0
    full_before = False
    open_text = _left_open(answer or "")
    for i, part in enumerate(parts):
        on = set()
        words = WORD.findall(part.lower())
        tokens = re.findall(r"[\w’']+", part.lower().replace("’", "'"))
        lang = language(part, common)
        seen = set(tokens)
        own = _overlap(words, places) if asked and words else 0
        if words and asked:
            share, cover = own / len(words), own / len(asked)
            if share >= 0.75 and cover >= 0.75:
                on.add("echo_all")
            elif cover >= 0.75 or (share >= 0.7 and cover >= 0.6):
                on.add("echo_most")
            elif share >= 0.6 and len(words) > 3:
                on.add("echo_some")
            if cover >= 0.75:
                on.add("covers_question")
        plain = " ".join(words)
        if plain in ECHO_FRAMES or plain.startswith(_ECHO_STARTS):
            on.add("echo_frame")
        if lang is None or asked_language is None:
            on.add("no_language")
        else:
            on.add("same_language" if lang == asked_language else "other_language")
        cited = bool(_CITATION.search(part))
        core = _CITATION.sub("", part).rstrip()
        end = core[-1:] if core else ""
        stripped = core.rstrip("\"”»')]")
        last_word = words[-1] if words else ""
        if core.endswith(("...", "…")):
            on.add("ends_ellipsis")
        elif re.search(r"\b(?:i\.e|e\.g|cf|viz|vs|d\.h|z\.B|p\.ej|c\.-à-d)\.$", core):
            on.add("ends_short")
        elif cited and end not in ",;:-–":
            on.add("ends_cited")
        elif stripped[-1:] in tuple(".!?。！？"):
            on.add("ends_full")
        elif end in tuple(",;:-–([“"):
            on.add("ends_half")
        else:
            on.add("ends_bare")
        if last_word in _HANGING and "ends_full" not in on:
            on.add("hanging")
        item = i in items
        if item:
            on.add("item")
        if i == len(parts) - 1:
            on.add("last")
            if open_text:
                on.add("left_open")
            if len(parts) == 1:
                on.add("only")
            if "ends_bare" in on and not item and full_before:
                on.add("last_bare_after_full")
            if item and "ends_bare" in on:
                on.add("last_item_bare")
            if item and "ends_half" in on:
                on.add("last_item_half")
            if promised > len(items):
                on.add("promised_more")
        if "ends_full" in on:
            full_before = True
        if part.endswith(":"):
            promised = max([promised, *(_NUMBERS[w] for w in words if w in _NUMBERS)])
        size = len(words) + (0 if part.isascii() else len(_HAN.findall(part)) // 2)
        speaker, denial, ability, context = bool(seen & _SPEAKER), bool(seen & _DENIAL) or "n't" in part, bool(seen & _ABILITY), bool(seen & _CONTEXT)
        knowing, rule, telling = bool(seen & _KNOWING), bool(seen & _RULE), bool(seen & _TELLING)
        topics = sum(w not in _TOPICLESS and w not in asked_set and w not in common for w in set(tokens))
        third = bool(re.match(r"(?:the authors|it does|they |he |she |the paper says)", part.lower()))
        for name, is_on in (
            ("speaker", speaker), ("denial", denial), ("ability", ability), ("sorry", bool(seen & _SORRY)), ("context", context), ("courtesy", len(seen & _COURTESY) >= 2 or (bool(seen & _COURTESY) and len(words) <= 6)),
            ("opener", plain.startswith(_OPENERS)), ("speaker_denial", speaker and denial), ("denial_ability", denial and ability and not third), ("denial_context", denial and context and len(words) <= 14),
            ("speaker_ability", speaker and ability), ("third_person", third), ("long", size > 14), ("short", size <= 4), ("name_only", len(words) <= 2 and part.endswith(":")), ("after_answer", i > 0),
            ("knowing", knowing), ("rule", rule), ("telling", telling), ("topicless", not topics), ("one_topic", topics == 1), ("speaker_knowing", speaker and knowing), ("speaker_rule", speaker and rule), ("denial_telling", denial and telling and not third),
            ("denial_this", denial and bool(seen & _THIS)), ("topicless_denial", not topics and denial), ("topicless_rule", not topics and rule), ("one_topic_denial_context", topics == 1 and denial and context), ("only_hanging", len(parts) == 1 and "hanging" in on), ("topicless_other_language", not topics and "other_language" in on),
        ):
            if is_on:
                on.add(name)
        on.add("bias")
        for f in on:
            rows[i, _AT[f]] = 1.0
    return parts, rows


class Crf:
    """A linear-chain conditional random field over the tags."""

    def __init__(self):
        k, f = len(TAGS), len(FEATURES)
        self.weight, self.step, self.first, self.final = np.zeros((f, k)), np.zeros((k, k)), np.zeros(k), np.zeros(k)

    def _params(self) -> list[np.ndarray]:
        return [self.weight, self.step, self.first, self.final]

    def fit(self, data: list[tuple[np.ndarray, list[int]]], rounds: int = ROUNDS, rate: float = 0.1, ridge: float = 1e-3) -> Crf:
        """Gradient ascent (Adam) on the mean conditional log-likelihood."""
        n, size, k = len(data), max(len(y) for _, y in data), len(TAGS)
        x, y, mask = np.zeros((n, size, len(FEATURES))), np.zeros((n, size), int), np.zeros((n, size), bool)
        for i, (rows, tags) in enumerate(data):
            x[i, : len(tags)], y[i, : len(tags)], mask[i, : len(tags)] = rows, tags, True
        flat = x.reshape(-1, x.shape[2])
        ends = mask.sum(1) - 1
        one = np.eye(k)[y] * mask[..., None]
        every = np.arange(n)
        moment = [(np.zeros_like(p), np.zeros_like(p)) for p in self._params()]
        for step in range(1, rounds + 1):
            score = x @ self.weight
            alpha, beta = np.zeros((n, size, k)), np.zeros((n, size, k))
            alpha[:, 0] = score[:, 0] + self.first
            for t in range(1, size):
                alpha[:, t] = _logsum(alpha[:, t - 1][:, :, None] + self.step, 1) + score[:, t]
            beta[every, ends] = self.final
            for t in range(size - 2, -1, -1):
                later = _logsum(self.step + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
                beta[:, t] = np.where((t < ends)[:, None], later, beta[:, t])
            total = _logsum(alpha[every, ends] + self.final, 1)
            margin = np.exp(alpha + beta - total[:, None, None]) * mask[..., None]
            grad_step = np.zeros((k, k))
            for t in range(1, size):
                on = mask[:, t]
                both = np.exp(alpha[on, t - 1][:, :, None] + self.step + (score[on, t] + beta[on, t])[:, None, :] - total[on][:, None, None])
                grad_step += one[on, t - 1].T @ one[on, t] - both.sum(0)
            gap = one - margin
            grads = [flat.T @ gap.reshape(-1, k), grad_step, gap[:, 0].sum(0), (one[every, ends] - margin[every, ends]).sum(0)]
            for p, g, (m, v) in zip(self._params(), grads, moment):
                g = g / n - ridge * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def tag(self, rows: np.ndarray) -> list[int]:
        """The most probable tags (Viterbi)."""
        score = rows @ self.weight
        best, came = score[0] + self.first, []
        for t in range(1, len(score)):
            all_ = best[:, None] + self.step
            came.append(all_.argmax(0))
            best = all_.max(0) + score[t]
        tags = [int((best + self.final).argmax())]
        for c in came[::-1]:
            tags.append(int(c[tags[-1]]))
        return tags[::-1]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


# --- the grammar that writes the training sequences -------------------------

_NOUNS = "engine valve river bridge market index table method model soil crop signal filter sample paper theory region window letter city".split()
_SAYS = {
    "en": ("The {a} of the {b} is measured before the {c} is used.", "We find that each {a} depends on the {b}.", "There is a strong {a} between the {b} and the {c}.", "In this case the {a} was not better than the {b}.", "It drops to 7.3 after the {a} is changed.", "To reduce the {a}, every {b} is tested twice.", "I found the {a} part hard to read, and the {b} is used only once.", "Both N1 and N2 rely on a {a}, but only the latter keeps its {b}.", "No {a} was used twice unless its {b} had changed.", "You could also ask why the {a} is never used with the {b}.", "The authors of N1 report a {a} of 7.3 but the {b} remains open.", "It is not clear whether the {a} changes the {b} used in the {c}."),
    "de": ("Wir zeigen, dass das {a} bei der Suche nach dem {b} hilft.", "Daher ist das {a} für die {b} nicht zu groß.", "Im Vergleich zu N1 wird das {a} um 3 Prozent kleiner.", "Auch ohne das {a} bleibt das {b} auf dem N2 gleich.", "Der Text sagt nicht, wie das {a} mit dem {b} hilft, aber das ist erlaubt."),
    "fr": ("Nous pensons que le {a} est plus grand que le {b} dans cette région.", "Par rapport à N1, le {a} ne change pas avec le {b}.", "Cette partie montre comment le {a} est mesuré sur la {b}.", "Les auteurs pensent que le {a} et la {b} sont liés.", "Le document ne modifie pas le {a} lorsque la {b} n'est pas trop grande.", "Rien ne change dans le texte de la {a}, mais le {b} aide à répondre."),
    "es": ("El {a} no es más grande que la {b} en esta región.", "Por eso un {a} no basta para una {b} grande.", "En comparación con N1, el {a} cambia el {b} en la mayoría.", "Los autores creen que el {a} y el {b} son iguales.", "El texto no dice nada de la {a}, pero el {b} no cambia."),
    "zh": ("我们发现河流能够改变城市的结果。", "因此新的方法并不适合大的市场。", "本节说明如何用模型来改进样本。"),
}
_ASKS = {
    "en": ("What limits the {a} of N1 on the {b}?", "Why is N1 combined with a {a} for the {b}?", "How does N1 treat the {a}?", "Compare N1 with N2 on the {a}.", "Explain the role of N1 in the {b}."),
    "de": ("Welche Rolle spielt das {a} in N1 und warum?", "Wie wird das {a} mit dem {b} gemessen?"),
    "fr": ("Quel rôle joue le {a} dans N1 et pourquoi ?", "Comment le {a} est-il mesuré sur la {b} ?"),
    "es": ("¿Qué papel tiene el {a} en N1 y por qué?", "¿Cómo se mide el {a} en la {b}?"),
    "zh": ("为什么我们在城市的市场上没有新的方法？",),
}
#: Forms of refusals; {x|y} takes one of its parts.
_REFUSALS = (
    "I {cannot|can't|am unable to|am not able to|won't|could not|must decline to|would rather not} {answer|say|tell|help with|comment on|respond to|speak to|discuss|judge} {this|that|it|your question|the {a}|N1}.",
    "{There is|There's} {no|not enough|too little} {information|context|material|detail} {here|in the text|in the sources|to answer this|on the {a}}.",
    "The {passages|documents|sources|excerpts} {do not|don't} {say|mention|cover|contain|discuss} {this|it|the {a}|anything on N1|enough information}.",
    "The {context|text|material|passage} {does not|doesn't} {say|mention|cover|contain|state} {this|it|the {a}|how N1 works|the answer}.",
    "I {have no|lack} {access to|knowledge of|information on|opinion on} {this|that|the {a}|N1}.",
    "{This|That|It|Your question} {is|lies|falls} {outside|beyond} {of what I may discuss|my scope|my remit|the given text|what I can judge}.",
    "{Nothing|None of it} in the {passages|context|documents|sources} {says|tells me|explains|covers|mentions} {this|it|how N1 works|the {a}}.",
    "{My rules|The rules I follow|My instructions} {do not allow|prevent} {an answer|an answer to this|that}.",
    "I am {not|no longer} {allowed|permitted} to {answer|discuss|say} {this|that|it}.",
    "No {answer|reply|statement} {is possible|can be given|can be made}{| here| from the text}.", "No {answer|reply} {is possible|can be given}.",
    "The answer {is not given|cannot be found|is nowhere stated|cannot be determined} {in|from} the {text|context|passages}.",
    "I {do not|don't} know{| this| the answer| that}.", "I am not {sure|certain}{| about this| about the {a}}.", "{This|The answer} is {unknown|unclear} to me.", "N1 is not mentioned in the {context|passages|text}.",
    "{I must pass|I have to leave this question open|I must decline|I'd rather not guess}.", "It is not possible {for me to respond|to say|to answer this}.", "The sources are silent on {N1|this} and I won't guess.", "The information is insufficient{| to answer this}.",
    "Das kann ich {leider nicht|nicht} {beantworten|sagen}.", "{Dazu|Darüber} {weiß ich nichts|kann ich nichts sagen}.", "Der Text sagt {dazu nichts|das nicht}.", "Je ne {sais pas répondre à cette question|peux pas répondre|sais pas}.", "Le texte ne dit {rien|pas cela}.", "No puedo {responder a esta pregunta|decir nada}.", "No {lo sé|sé responder}.",
)
_OPENING = ("I'm sorry, but ", "Unfortunately, ", "With regret, ", "As a language model, ", "Based on the given context, ", "After reading the text, ", "Hm, ", "", "", "")
_BEFORE = ("Sorry.", "{Thank you|Thanks} for {asking|the question}.", "My apologies:", "I'm afraid not.")
_AFTER = ("I hope you understand.", "Please {consult|see|ask} the {authors|paper|original text|{a}}{| instead}.", "Is there anything else you would like to know?", "{Please ask|Try} another question.", "You could look at the {paper|sources|{a}} instead.")
_BRIEF = ("A new {a}.", "N1.", "Yes.", "No, it does not.", "12.5 points.", "Mainly through the {a} of N1.", "A {a}", "It drops to 7.3", "Mainly through the {a} of N1", "The paper says that N1 slowly changes the {a}", "In N1 the {a} is used before the {b}", "N1 changes the {a} by means of a new {b}")
_DECOYS = (
    "The authors cannot answer why the {a} fails and are sorry about the missing {b}.", "It does not know the {a} in advance, so nothing can be said before the {b}.", "They do not know the {a} and leave the {b} open.", "The paper leaves the {a} open.", "The method cannot help with the {a} without any {b}.",
    "Nothing in the {a} changes the {b}.", "No {a} contains the {b} of N1.", "The {a} lies outside the {b}.", "The paper does not say whether the {a} changes the {b}, but N1 keeps it.", "The rules of N1 forbid a second {a}.", "The context of the {a} is not enough for the {b}.", "The {a} lacks a {b} and cannot respond to the {c}.",
    "My reading is that the {a} drives the {b}.", "I think the {a} is not too small for the {b}.", "We cannot compare the {a} with N1, but the {b} is smaller.", "The policy of the {a} is not known before the {b}.", "A {a} beyond the {b} is not supported by N1.", "It is unknown which {a} the {b} used, yet N1 found it.", "The question of the {a} is answered by the {b}, not by N1.",
)
_CUTS = ("This is due to the", "For example, the {a}", "It uses:\n```\nfor x in", "The {a} is made by the same rule, i.e.", "(see the {a}, cf.", "The paper states: “The {a} is never used, and the [")


_CHOICE = re.compile(r"\{([^{}]*(?:\{[abc]\}[^{}]*)*\|[^{}]*(?:\{[abc]\}[^{}]*)*)\}")


def _filled(rng: random.Random, pattern: str) -> str:
    while _CHOICE.search(pattern):
        pattern = _CHOICE.sub(lambda m: rng.choice(m.group(1).split("|")), pattern, count=1)
    names = [rng.choice("BDGKLMPRST") + "".join(rng.choice(["ra", "lo", "mi", "ku", "ste", "vor"]) for _ in range(3)) for _ in range(2)]
    text = pattern
    for slot in "abc":
        text = text.replace("{" + slot + "}", rng.choice(_NOUNS))
    return text.replace("N1", names[0]).replace("N2", names[1])


def _example(rng: random.Random) -> tuple[str, list[tuple[str, int]], str]:
    """A question, the clauses of an answer with their tags, and the joint."""
    lang = rng.choice(["en"] * 5 + ["de", "fr", "es", "zh"])
    question = _filled(rng, rng.choice(_ASKS[lang]))
    say = lambda n, of=lang: [(_filled(rng, rng.choice(_SAYS[of])), ANSWER) for _ in range(n)]
    kind = rng.randrange(12)
    if kind == 0:
        return question, say(rng.randint(1, 4)), " "
    if kind == 1:
        return question, [(_filled(rng, rng.choice(_BRIEF)), ANSWER)], " "
    if kind == 2:
        body = [*say(rng.randint(1, 2)), (_filled(rng, rng.choice(_DECOYS)), ANSWER), *say(rng.randint(0, 2))]
        return question, body, " "
    if kind == 3:
        body = say(rng.randint(1, 3))
        cited = rng.choice([" [3]", " [12]", " (see the valve)", " [2, 5]"])
        return question, [*body[:-1], (body[-1][0].rstrip(".") + cited, ANSWER)], " "
    if kind == 4:
        end, last = rng.choice([(";", "."), ("", ""), (".", ".")])
        n = rng.randint(2, 4)
        items = [(f"{i + 1}) " + _filled(rng, "new {a}") + (last if i == n - 1 else end), ANSWER) for i in range(n)]
        head = [(f"There are {['two', 'three', 'four'][n - 2]} reasons:", ANSWER)] if rng.random() < 0.4 else say(1)
        return question, [*head, *items], "\n"
    if kind == 5:
        return question, [(question, ECHO), *say(rng.randint(1, 3))], " "
    if kind == 6:
        echo = question
        style = rng.randrange(6)
        if style == 0:
            echo = echo.lower()
        elif style == 1:
            echo = echo.rstrip(".?")
        elif style == 2:
            echo = f'"{echo}"'
        elif style == 3:
            words = echo.split(" ")
            words.insert(rng.randint(1, len(words)), rng.choice(_NOUNS))
            echo = " ".join(words)
        elif style == 4:
            echo = echo.upper()
        parts = [(echo, ECHO)] * rng.choice([1, 1, 2])
        if rng.random() < 0.3:
            parts = [(rng.choice(["You asked:", "The question is:", "Question:", "Q:"]), ECHO), *parts]
        return question, parts, " "
    if kind in (7, 8):
        core = _filled(rng, rng.choice(_REFUSALS))
        opening = rng.choice(_OPENING)
        parts = [(opening + (core[0].lower() + core[1:] if opening and not core.startswith(("I ", "N")) else core), REFUSAL)]
        if not opening and rng.random() < 0.5:
            parts = [(_filled(rng, rng.choice(_BEFORE)), REFUSAL), *parts]
        if rng.random() < 0.5:
            parts.append((_filled(rng, rng.choice(_AFTER)), REFUSAL))
        return question, parts, " "
    if kind == 9:
        other = rng.choice([x for x in _SAYS if x != lang])
        parts = [(t, FOREIGN) for t, _ in say(rng.randint(1, 4), other)]
        if rng.random() < 0.3:
            parts = [(_filled(rng, "N1:"), FOREIGN), *parts]
        return question, parts, " "
    body = say(rng.randint(1, 4))
    if kind == 10:
        text = body[-1][0]
        words = text.split(" ")
        if len(words) > 3:
            cut = " ".join(words[: rng.randint(2, len(words) - 1)]).rstrip(".!?")
            cut = cut[: rng.randint(max(4, len(cut) - 4), len(cut))]
        else:
            cut = text[: max(4, len(text) // 2)]
        cut += rng.choice(["", "", "", "", "…", "...", " …", ",", " ("])
        before = [*say(1), *body[:-1]]
        # A clause alone is known to be cut by a word that can't be its last.
        ends = [i for i, w in enumerate(words) if i and w.lower() in _HANGING]
        if lang != "zh" and ends and rng.random() < 0.35:
            before, cut = [], " ".join(words[: rng.choice(ends) + 1])
        return question, [*before, (cut, UNFINISHED)], " "
    style = rng.randrange(3)
    if style:
        return question, [*body, *[(x, UNFINISHED if i else ANSWER) for i, x in enumerate(["", *_filled(rng, rng.choice(_CUTS)).split("\n")]) if x]], " "
    n = rng.randint(1, 2)
    items = [(f"{i + 1}) " + _filled(rng, "new {a}") + rng.choice([";", ";", ""]), ANSWER) for i in range(n)]
    return question, [*body, ("There are three reasons:", ANSWER), *items[:-1], (items[-1][0], UNFINISHED)], "\n"


def train(common: dict[str, tuple[str, ...]], examples: int = EXAMPLES, seed: int = SEED) -> Crf:
    rng = random.Random(seed)
    data = []
    while len(data) < examples:
        question, parts, joint = _example(rng)
        tags = [(i, t) for i, (_, t) in enumerate(parts)]
        cut, rows = features(question, joint.join(p for p, _ in parts), common)
        # A clause of the grammar may be cut further; its parts share its tag.
        labels, at = [], 0
        for c in cut:
            while at < len(parts) - 1 and c[:12] not in parts[at][0]:
                at += 1
            labels.append(tags[at][1])
        if cut:
            data.append((rows, labels))
    return Crf().fit(data)


def coverage(parts: list[str], tags: list[int]) -> tuple[list[int], list[int]]:
    """The characters that each tag covers, and those up to the end that it
    covers without another between."""
    size, tail = [0] * len(TAGS), [0] * len(TAGS)
    for p, t in zip(parts, tags):
        size[t] += len(p)
    for p, t in zip(parts[::-1], tags[::-1]):
        if t != tags[-1]:
            break
        tail[t] += len(p)
    return size, tail


def defect(question: str | None, answer: str | None, model: Crf, common: dict[str, tuple[str, ...]]) -> tuple[str | None, list[tuple[str, str]]]:
    """The defect of an answer, or None, and its clauses with their tags."""
    parts, rows = features(question, answer, common)
    tags = model.tag(rows) if parts else []
    size, tail = coverage(parts, tags)
    tagged = [(p, TAGS[t]) for p, t in zip(parts, tags)]
    whole = sum(size)
    if not whole:
        return "empty", tagged
    if size[FOREIGN] * 2 > whole:
        return "language", tagged
    if tail[UNFINISHED]:
        return "truncated", tagged
    if not size[ANSWER]:
        return "refusal" if size[REFUSAL] else "copy" if size[ECHO] else None, tagged
    return None, tagged


def common_words(rows: list) -> dict[str, tuple[str, ...]]:
    found: dict[str, tuple[str, ...]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.word)):
        found[r.word] = (*found.get(r.word, ()), r.lang)
    return found


def defects(records: DataFrame, key: str, question: str, answer: str, words: DataFrame) -> DataFrame:
    """(record_id, defect, clauses): every record; defect null if sound."""
    common = common_words(bounded_rows(words.select("lang", "word").where("word is not null and lang is not null"), "the table of common words"))
    sent = records.sparkSession.sparkContext.broadcast((train(common), common))
    source = records.select(records[key].cast("long").alias("record_id"), records[question].alias("q"), records[answer].alias("a"))
    kind = pa.list_(pa.struct([("text", pa.string()), ("tag", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = sent.value
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                found = [defect(q, a, model, known) for q, a in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                lists = [[{"text": p, "tag": t} for p, t in tagged] for _, tagged in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([d for d, _ in found], pa.string()), pa.array(lists, kind)], ["record_id", "defect", "clauses"])

    return source.mapInArrow(run, "record_id long, defect string, clauses array<struct<text string, tag string>>")


def _defects(spark: SparkSession, sf_dir: str, records: DataFrame) -> DataFrame:
    return defects(records, "record_id", "question", "answer", table(spark, sf_dir, "common_words"))


def p1_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its clauses, their tags and its defect."""
    records = table(spark, sf_dir, "eval_records").select("record_id", "question", "answer", "loaded_at")
    return _defects(spark, sf_dir, first_loads(records, ["record_id"], [F.col("loaded_at"), F.xxhash64("answer")]))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _defects(spark, sf_dir, table(spark, sf_dir, "eval_records")).where("defect is not null").select("record_id", "defect").distinct()


QUERIES = {"p1_clauses": p1_clauses, "p1_found": p1_found}
SQL: dict[str, str] = {}
