"""Settings shared by the jobs. Every number here can be overridden per call."""

from __future__ import annotations

from dataclasses import dataclass

# Page statuses.
OK = "ok"
TOO_LONG = "too_long"
EMPTY = "empty"
ERROR = "error"
SETTLED_PARSE = (OK, TOO_LONG, EMPTY)
SETTLED_CHECK = (OK,)

# Quote verdicts, most specific first, and the label of a missing one.
QUOTE_TOO_SHORT = "troppo corta"
QUOTE_INVENTED = "inventata"
QUOTE_PRESENT = "presente"
QUOTE_CONFIRMED = "confermata"
QUOTE_UNKNOWN = "sconosciuto"
PROVIDER_UNDECLARED = "(non dichiarato)"

# Providers.
RULES_PROVIDER = "locale"
REMOTE_PROVIDERS = ("openrouter",)

# Replies, and what is said of those that cannot be read.
NOTHING_HERE = "NOTHING_HERE"
FINISH_TRUNCATED = "length"
JUDGE_WITHOUT_JSON = "No JSON object found in response: "
JUDGE_BAD_JSON = "Invalid JSON from judge: "
CHECK_CUT = "Reply cut at the {tokens} token ceiling, not a formatting error: "
CHECK_WITHOUT_JSON = "No JSON object in reply: "
CHECK_BAD_JSON = "Invalid JSON from model: "


@dataclass(frozen=True)
class Budgets:
    """Token budgets of a model call."""

    context_tokens: int = 128_000
    answer_tokens: int = 16_384
    prompt_tokens: int = 2_500
    check_answer_tokens: int = 2_048
    chars_per_token: float = 3.0
    safety: float = 1.15


@dataclass(frozen=True)
class Thresholds:
    """Cut-offs of the reference-free checks. ``max_quotes`` of None keeps every quote."""

    anchor_words: int = 8
    line_chars: int = 40
    quote_chars: int = 25
    grounded_from: float = 0.6
    coherent_from: int = 3
    coherence_max: int = 5
    max_quotes: int | None = 3
    seam_lines: int = 12
    preview_chars: int = 1_000
    reply_excerpt: int = 200


@dataclass(frozen=True)
class LocalMachine:
    """What a second of work on the local machine costs."""

    power_watts: float = 1.52
    eur_per_kwh: float = 0.236
    hardware_eur: float = 1250.74
    lifetime_years: float = 8.0

    @property
    def electricity_per_second(self) -> float:
        return self.power_watts / 3600 / 1000 * self.eur_per_kwh

    @property
    def hardware_per_second(self) -> float:
        return self.hardware_eur / (self.lifetime_years * 365 * 24 * 3600)


BUDGETS = Budgets()
THRESHOLDS = Thresholds()
LOCAL_MACHINE = LocalMachine()
EUR_PER_USD = 0.92
SWEEP_BUDGETS = (60_000, 100_000, 180_000, 262_144)
