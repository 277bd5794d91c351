"""The gate of guidance extraction: whether, where and how a release speaks of its outlook, by a configurable set of cues.

A gate opens by a guidance word near a verb of change, confirmation or first issue, near an `unchanged` word or near a number, by a
guidance word with a period beside it, or by a forward-looking word near a metric. Of several pairs the nearest counts. A strong
trigger (a profit warning) is noted, unless it is denied nearby, but opens nothing by itself.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import lru_cache

from tidewire.functions.text import NORDIC
from tidewire.operators.cues import Places

#: The default configuration. Terms are stems of three letters or more, patterns regular expressions; `@name` names a list.
DEFAULTS = {
    "key": "guidance_change",
    "thresholds": {
        "proximity": {"mode": "token", "fwd_cue_metric_chars": 120, "fwd_cue_metric_tokens": 10, "allow_cross_sentence": False, "look_left_sentences": 0, "look_right_sentences": 0},
        "unchanged_markers_en": ["unchang", "in line", "no change", "as previously", "as prior"],
        "unchanged_markers_sv": ["oföränd", "i linje med", "som tidigare", "som tidigare kommunicerats", "ingen förändring"],
    },
    "patterns": {
        "triggers": {
            "en_any": [r"\bprofit\s+(warning|alert)s?\b", r"\b(?:write[ -]?down|write[ -]?off|impairment(?:\s+charge)?s?)\b"],
            "sv_any": [r"\bomvänd\s+vinstvarning\b|\bvinstvarning\b", r"\b(nedskrivning(ar)?|nedskrivnings(post|kostnad)(er)?|engångsnedskrivning(ar)?|nedskrivningsbehov)\b"],
        },
        "fwd_cue": {
            "terms": {
                "en": ["expect", "expects", "project", "projects", "aim", "target", "targets", "anticipate", "plan", "intend", "will", "should", "we see", "we believe", "we expect", "guiding"],
                "sv": ["förväntar", "räknar med", "siktar", "målsätter", "planerar", "avser", "kommer att", "bör", "vi ser", "vi tror", "förväntas", "väntas", "bedöms"],
            }
        },
        "guidance_proximity_rules": [
            {
                "name": "en_guidance_change", "type": "guidance_change", "window_tokens": 10,
                "verbs": ["raise", "raises", "raised", "raising", "lower", "lowers", "lowered", "lowering", "revise", "revises", "revised", "revising", "update", "updates", "updated", "updating", "withdraw", "withdraws", "withdrew", "withdrawn", "suspend", "suspends", "suspended", "suspending", "narrow", "narrows", "narrowed", "narrowing", "widen", "widens", "widened", "widening"],
                "guidance_markers": ["guidance", "outlook", "forecast", "full-year guidance", "fy guidance", "guidance range"],
            },
            {
                "name": "en_guidance_unchanged_verbal", "type": "guidance_unchanged", "window_tokens": 10,
                "verbs": ["reaffirm", "reaffirms", "reaffirmed", "reaffirming", "maintain", "maintains", "maintained", "maintaining", "keep", "keeps", "kept", "keeping", "leave", "leaves", "left", "leaving"],
                "guidance_markers": ["guidance", "outlook", "forecast", "full-year guidance", "fy guidance"],
            },
            {"name": "en_guidance_unchanged_token", "type": "guidance_unchanged", "window_tokens": 6, "unchanged_tokens": "@unchanged_markers_en", "guidance_markers": ["guidance", "outlook", "forecast", "full-year guidance", "fy guidance"]},
            {
                "name": "en_guidance_initiate", "type": "guidance_initiate", "window_tokens": 10, "require_period_token": True,
                "verbs": ["initiate", "initiates", "initiated", "initiating", "provide", "provides", "provided", "providing", "issue", "issues", "issued", "issuing", "set", "sets", "setting", "introduce", "introduces", "introduced", "introducing", "publish", "publishes", "published", "publishing", "present", "presents", "presented", "presenting"],
                "guidance_markers": ["guidance", "outlook", "forecast", "full-year guidance", "fy guidance"],
            },
            {
                "name": "sv_guidance_change", "type": "guidance_change", "window_tokens": 10,
                "verbs": ["höja", "höjer", "höjde", "höjs", "sänka", "sänker", "sänkte", "sänks", "uppdatera", "uppdaterar", "uppdaterade", "uppdateras", "precisera", "preciserar", "preciserade", "preciseras", "snäva in", "snävar in", "snävade in", "snävas in", "bredda", "breddar", "breddade", "breddas"],
                "guidance_markers": ["prognos", "utsikter", "helårsprognos", "fy-prognos", "guidning", "mål", "målsättning"],
            },
            {
                "name": "sv_guidance_unchanged_verbal", "type": "guidance_unchanged", "window_tokens": 10,
                "verbs": ["upprepa", "upprepar", "upprepade", "upprepas", "bekräfta", "bekräftar", "bekräftade", "bekräftas", "lämna", "lämnar", "lämnade", "lämnas"],
                "guidance_markers": ["prognos", "utsikter", "helårsprognos", "fy-prognos", "guidning", "mål", "målsättning"],
            },
            {"name": "sv_guidance_unchanged_token", "type": "guidance_unchanged", "window_tokens": 6, "unchanged_tokens": "@unchanged_markers_sv", "guidance_markers": ["prognos", "utsikter", "helårsprognos", "fy-prognos", "guidning", "mål", "målsättning"]},
            {
                "name": "sv_guidance_initiate", "type": "guidance_initiate", "window_tokens": 10, "require_period_token": True,
                "verbs": ["initiera", "initierar", "initierade", "initieras", "introducera", "introducerar", "introducerade", "introduceras", "lansera", "lanserar", "lanserade", "lanseras", "presentera", "presenterar", "presenterade", "presenteras", "publicera", "publicerar", "publicerade", "publiceras", "kommunicera", "kommunicerar", "kommunicerade", "kommuniceras", "fastställa", "fastställer", "fastställde", "fastställs"],
                "guidance_markers": ["prognos", "utsikter", "helårsprognos", "fy-prognos", "guidning", "mål", "målsättning"],
            },
        ],
        "numeric_guidance_rules": [
            {"name": "en_guidance_numeric", "window_tokens": 8, "require_number": True, "guidance_markers": ["guidance", "outlook", "forecast", "full-year guidance", "fy guidance"]},
            {"name": "sv_guidance_numeric", "window_tokens": 8, "require_number": True, "guidance_markers": ["prognos", "utsikter", "helårsprognos", "fy-prognos", "guidning", "mål", "målsättning"]},
        ],
        "guidance_text_stub_rules": [
            {"name": "en_guidance_interval_stub", "markers": ["guidance interval", "guidance range", "targeted guidance interval", "within the guidance interval", "within the guidance range"]},
            {"name": "sv_guidance_interval_stub", "markers": ["prognosintervall", "målintervall", "guidningsintervall", "inom prognosintervallet"]},
        ],
        "dir_up": {"any": [r"\b(improv\w+|increase\w*|expand\w*|grow\w*|strengthen\w*|better|öka\w*|väx\w*|stig\w*|förbättr\w*|tillta\w*)\b"]},
        "dir_dn": {"any": [r"\b(declin\w+|decreas\w+|contract\w*|pressure|pressures|headwind\w*|worse|minsk\w*|sjunk\w*|försämr\w*|avta\w*)\b"]},
        "invite": {"any": [r"\b(invite|invitation|webcast|earnings\s+call|fireside\s+chat|reminder|capital\s+markets\s+day|cmd|kapitalmarknadsdag(en)?)\b"]},
        "disclaimer_block": {"any": [r"(forward[-\s]looking\s+statements|safe\s+harbor|cautionary\s+statement)"]},
        "disclaimer_inline": {"any": [r"(statements?\s+that\s+are\s+not\s+historical|subject\s+to\s+risks\s+and\s+uncertainties)"]},
        "suppressors": {
            "analyst": {"any": [r"\bconsensus\b|\bBloomberg\b|\bFactSet\b|\bRefinitiv(e)?\b"]},
            "macro": {"any": [r"\b(industry|sector|marknaden|industrin)\b"]},
            "ma": {"any": [r"\b(acquisition|purchase price|enterprise value|offer|bid|förvärv|bud)\b"]},
            "debt": {"any": [r"\b(coupon|bond|loan|interest|facility|revolver|ränta|lån)\b"]},
        },
    },
    "terms": {
        "dir_up_terms": ["improve", "improving", "increase", "increasing", "expand", "grow", "strengthen", "better", "förbättra", "förbättras", "öka", "ökande", "stärka", "bättre"],
        "dir_dn_terms": ["decline", "declining", "decrease", "decreasing", "contract", "pressure", "headwinds", "worse", "försämra", "försämras", "minska", "minskande", "press", "motvind", "sämre"],
    },
    "tokens": {
        "expected_forward_en": ["is expected", "are expected", "expected to", "expected at", "expected around", "we expect", "the company expects"],
        "expected_past_en": ["as expected", "was expected", "were expected", "was expecting", "were expecting", "had expected", "had been expected", "previously expected", "earlier expected"],
    },
}

#: Words that stand for themselves only, denials of a trigger, the company speaking, and what a period begins with.
EXACT = frozenset(("will", "should", "we", "vi", "see", "ser", "att", "bör"))
DENIED = (
    r"\b(deny|denies|denied|refute|refutes|refuted|no\s+(?:plans?|intention)s?\s+to|not\s+(?:planning|intending|issuing|updating|withdrawing)|"
    r"without\s+(?:issuing|changing|updating)|does\s+not\s+(?:intend|expect|plan)|nekar|förnekar|inga\s+planer|inte\s+(?:avsikt|förväntar|planerar))\b"
)
COMPANY = r"\b(we|our|the\s+company|the\s+group|vi|vår(?:a|t)?|bolaget|koncernen)\b"
NO_GUIDANCE = r"(?:\bno\s+guidance\b)|(?:\b(?:does|do|will)\s+not\s+(?:provide|issue|give)\s+guidance\b)|(?:does\s+not\s+intend\s+to\s+provide\s+guidance)"
_PERIOD = re.compile(r"(?:fy|full-year|q[1-4]|h[12])?-?(?:(?:19|20)\d\d)?")
_TOKEN = re.compile(f"[a-z0-9{NORDIC}\\-]+")
_END = re.compile(r"(?<!\bca\.)(?<!\bapprox\.)(?<!\bc\.)(?<=[.!?])\s+(?=[^\d\s%])|\n+")
_QUOTES = str.maketrans("‘’“”–—", "''\"\"--")


@dataclass(frozen=True)
class Gate:
    """What opened: `source` (strong, fwd_cue, numeric_gate, text_gate), the rule's type, and the sentence of the cue."""

    source: str
    type: str | None
    sentence: int
    direction: str | None


@dataclass
class Text:
    """A release in sentences and tokens; `at` is each token's sentence, None for a token that no sentence holds."""

    text: str
    sentences: list[tuple[int, str]]
    words: list[str]
    spans: list[tuple[int, int]]
    at: list[int] = field(default_factory=list)


def read(text: str) -> Text:
    low = text.lower().translate(_QUOTES)
    low = low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text).translate(_QUOTES)
    sentences, begin = [], 0
    for m in _END.finditer(text):
        sentences.append((begin, text[begin : m.start()]))
        begin = m.end()
    sentences.append((begin, text[begin:]))
    found = list(_TOKEN.finditer(low))
    starts = [s for s, _ in sentences]
    return Text(text, sentences, [m[0] for m in found], [m.span() for m in found], [bisect_left(starts, m.start() + 1) - 1 for m in found])


def _union(patterns) -> re.Pattern:
    found = [p for p in patterns or () if p]
    return re.compile("|".join(f"(?:{p})" for p in found) or r"[^\s\S]", re.I)


def _words(terms) -> re.Pattern:
    return _union(r"(?<!\w)" + re.escape(t).replace("\\ ", r"[\s-]+") + r"(?!\w)" for t in terms)


class Cues:
    """A configuration, compiled."""

    def __init__(self, config: dict, metrics: tuple[str, ...]):
        thresholds, patterns, terms, tokens = (config.get(k) or {} for k in ("thresholds", "patterns", "terms", "tokens"))
        near = thresholds.get("proximity") or {}
        self.mode, self.chars, self.window = str(near.get("mode", "token")).lower(), int(near.get("fwd_cue_metric_chars", 120)), int(near.get("fwd_cue_metric_tokens", 25))
        self.across = bool(near.get("allow_cross_sentence", False))
        self.left, self.right = int(near.get("look_left_sentences", 0)), int(near.get("look_right_sentences", 0))
        named = {**patterns, **terms, **near, **thresholds}

        def listed(x) -> list[str]:
            return list(named.get(x[1:]) or ()) if isinstance(x, str) and x.startswith("@") else list(x or ())

        self.places = Places(EXACT)
        self.rules, self.numeric = [], []
        for i, rule in enumerate(patterns.get("guidance_proximity_rules") or ()):
            for part in ("verbs", "unchanged_tokens", "guidance_markers"):
                self.places.stemmed(f"{part}{i}", listed(rule.get(part)))
            self.rules.append((f"verbs{i}" if rule.get("verbs") else f"unchanged_tokens{i}", f"guidance_markers{i}", int(rule.get("window_tokens") or self.window), bool(rule.get("same_sentence", True)), bool(rule.get("require_period_token")), rule.get("type") or "guidance_change"))
        for i, rule in enumerate(patterns.get("numeric_guidance_rules") or ()):
            self.places.stemmed(f"numeric{i}", listed(rule.get("guidance_markers")))
            self.numeric.append((f"numeric{i}", int(rule.get("window_tokens") or self.window), bool(rule.get("require_number", True))))
        forward = (patterns.get("fwd_cue") or {}).get("terms") or {}
        self.forward = [t for lang in forward.values() for t in lang] + list(terms.get("fwd_cue_terms") or ())
        self.places.stemmed("forward", self.forward).stemmed("metric", [*metrics, "like for like"]).stemmed("guidance", ["guidance"])
        self.places.stemmed("up", terms.get("dir_up_terms") or ()).stemmed("down", terms.get("dir_dn_terms") or ())
        markers = [m for rule in patterns.get("guidance_text_stub_rules") or () for m in rule.get("markers") or ()]
        #: Every gate needs one of these terms.
        self.opening = [*self.forward, "guidance", *markers, *(m for part in ("guidance_proximity_rules", "numeric_guidance_rules") for rule in patterns.get(part) or () for m in listed(rule.get("guidance_markers")))]
        triggers = patterns.get("triggers") or {}
        self.trigger = _union(p for group in triggers.values() for p in group)
        self.stub = _words(markers)
        self.up, self.down, self.invite, self.block, self.inline = (_union((patterns.get(k) or {}).get("any")) for k in ("dir_up", "dir_dn", "invite", "disclaimer_block", "disclaimer_inline"))
        held_back = patterns.get("suppressors") or {}
        self.analyst, self.macro, self.deal, self.debt = (_union((held_back.get(k) or {}).get("any")) for k in ("analyst", "macro", "ma", "debt"))
        self.past, self.future = _words(tokens.get("expected_past_en") or ()), _words(tokens.get("expected_forward_en") or ())
        self.cue = _words(self.forward)
        self.denied, self.company, self.none = re.compile(DENIED, re.I), re.compile(COMPANY, re.I), re.compile(NO_GUIDANCE, re.I)

    def _nearest(self, t: Text, a: list[int], b: list[int], window: int, same: bool) -> tuple[int, int, int] | None:
        """(distance, place of a, place of b) of the closest pair within a window, in one sentence where asked."""
        found = [(abs(j - i), i, j) for i in a for j in b[bisect_left(b, i - window) : bisect_left(b, i + window + 1)] if not same or t.at[i] == t.at[j]]
        return min(found) if found else None

    def _period_near(self, t: Text, i: int, window: int) -> bool:
        return any(_PERIOD.fullmatch(w) for w in t.words[max(0, i - window) : i + window + 1])

    def gate(self, t: Text, numbers, dated) -> Gate | None:
        """The gate of a release; `numbers` gives the spans of its amounts and shares, `dated` tells whether a string names a period."""
        at = {k: sorted(set(v)) for k, v in self.places.find(t.words).items()}
        found = []
        for verb, marker, window, same, needs_period, kind in self.rules:
            near = self._nearest(t, at.get(verb, []), at.get(marker, []), window, same)
            if near and (not needs_period or self._period_near(t, near[2], window)):
                found.append((*near, kind))
        best = min(found, key=lambda x: x[0]) if found else None
        stated = [(i, window, needed) for name, window, needed in self.numeric for i in at.get(name, ())] if best is None else []
        spans = numbers() if any(needed for _, _, needed in stated) else []
        number = any(not needed or self._number_near(t, i, window, spans) for i, window, needed in stated)
        spoken = next((t.at[i] for i in at.get("guidance", ()) if self._period_near(t, i, 8) or dated(t.sentences[t.at[i]][1])), None)
        marker = self.stub.search(t.text)
        if marker and dated(t.sentences[(i := self._sentence_of(t, marker.start()))][1]):
            spoken = i
        if best is None and not number:
            near = self._nearest(t, at.get("forward", []), at.get("metric", []), self.window, True)
            best = (*near, "guidance_change") if near else None
        if best and not self._close(t, best) and self.mode in ("char", "both"):
            best = None
        if best is None and not number and spoken is None:
            return None
        direction = "up" if at.get("up") or (not at.get("down") and self.up.search(t.text)) else "down" if at.get("down") or self.down.search(t.text) else None
        kind = best[3] if best else None
        strong = self.trigger.search(t.text)
        denied = strong and self.denied.search(t.text[max(0, strong.start() - 60) : strong.end() + 60])
        source = "strong" if strong and not denied else "fwd_cue" if best else "numeric_gate" if number else "text_gate"
        sentence = t.at[best[1]] if best else spoken if spoken is not None else 0
        if best and not self._together(t, best):
            return None
        return Gate(source, kind, sentence, "flat" if kind == "guidance_unchanged" else direction)

    def _close(self, t: Text, pair) -> bool:
        middle = [sum(t.spans[i]) // 2 for i in pair[1:3]]
        return abs(middle[0] - middle[1]) <= self.chars

    def _together(self, t: Text, pair) -> bool:
        apart = t.at[pair[2]] - t.at[pair[1]]
        return -self.left <= apart <= self.right if self.across else apart == 0

    def _sentence_of(self, t: Text, at: int) -> int:
        return bisect_left([s for s, _ in t.sentences], at + 1) - 1

    def _number_near(self, t: Text, i: int, window: int, numbers: list[tuple[int, int]]) -> bool:
        lo, hi = t.spans[max(0, i - window)][0], t.spans[min(len(t.spans) - 1, i + window)][1]
        return any(lo <= a and b <= hi + 2 for a, b in numbers)

    def held_back(self, t: Text, gate: Gate, issuer: bool) -> bool:
        """Whether the sentence of the cue must not count: an invitation, a disclaimer, another's view, or a bare `will`."""
        begin, s = t.sentences[gate.sentence]
        block = self.block.search(t.text)
        if self.invite.search(s) or self.inline.search(s) or (block and begin + len(s) > block.start()):
            return True
        if not issuer and (self.analyst.search(s) or (self.macro.search(s) and not self.company.search(s))):
            return True
        if gate.type is None:
            return bool(self.none.search(s))
        bare = re.search(r"\b(will|kommer\s+att)\b", s, re.I) and not re.search(r"\b(guidance|outlook|forecast|target|aim|mål)\b|\d", s, re.I)
        return bool(bare)

    def looks_back(self, sentence: str) -> bool:
        """Whether a sentence tells what was expected."""
        return bool(self.past.search(sentence)) and not self.future.search(sentence)


@lru_cache(maxsize=8)
def default(metrics: tuple[str, ...]) -> Cues:
    return Cues(DEFAULTS, metrics)

