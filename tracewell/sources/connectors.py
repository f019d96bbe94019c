"""Model connectors: remote embeddings over an injected transport, pacing, retries with a fallback, local models.

They are used inside ``operators.embeddings.embedded`` and ``operators.inference.inferred``, whose factories run once in a
Python worker. A service with a limit per account wants one worker: ``coalesce(1)`` before.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import cache

from tracewell.operators.embeddings import prefixed, style_of

#: Texts of a request, requests a second before the service says more, spare time between two.
REMOTE_BATCH, PER_SECOND, SPARE = 64, 2.0, 1.15
#: Attempts, seconds to wait if the service names none, and for a whole window.
ATTEMPTS, NO_RESET, WINDOW, RESERVE = 3, 15, 62, 2


class ModelError(RuntimeError):
    """A model or its service failed."""


class QuotaError(RuntimeError):
    """The day's quota is used up: stop in order."""


class Pacer:
    """Least time between requests, and what the service has said about its limits."""

    def __init__(self, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.clock, self.sleep = clock, sleep
        self.per_second, self.free_from, self.limits = PER_SECOND, float("-inf"), {}

    def wait(self) -> None:
        pause = self.free_from - self.clock()
        if pause > 0:
            self.sleep(pause)
        self.free_from = self.clock() + SPARE / max(self.per_second, 0.1)

    def heard(self, headers: dict[str, str]) -> None:
        told = {k.lower(): v for k, v in headers.items() if "ratelimit" in k.lower() or k.lower() == "retry-after"}
        self.limits = told or self.limits
        limit = number(told.get("x-ratelimit-limit-second"))
        if limit and limit > 0:
            self.per_second = limit

    def push_back(self, seconds: float | None) -> None:
        if seconds and seconds > 0:
            self.free_from = max(self.free_from, self.clock() + seconds)

    def reset_seconds(self) -> float:
        told = number(self.limits.get("ratelimit-reset"))
        return NO_RESET if told is None or told < 0 else min(max(told, 1), WINDOW) + 3

    def check_quota(self) -> None:
        """Ends an exhausted day in order, and waits out a minute that is nearly used up."""
        day, minute = (number(self.limits.get(f"x-ratelimit-remaining-{k}")) for k in ("day", "minute"))
        if day is not None and day <= 0:
            raise QuotaError("the day's quota is used up")
        if minute is not None and minute <= RESERVE:
            self.sleep(self.reset_seconds())


def number(text) -> float | None:
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


#: (payload, key) -> (status, headers, body): how a request is sent; tests and users bring their own.
Post = Callable[[dict, str], tuple[int, dict, dict]]
HINTS = {401: "the key is not valid", 404: "no such model", 429: "too many requests"}


def remote_embed(post: Post, model: str, key: str, pacer: Pacer | None = None, batch: int = REMOTE_BATCH) -> Callable[[list[str], bool], list[list[float]]]:
    """An embedding function over a service that takes {input, model} and returns {data: [{index, embedding}]}."""
    if not key:
        raise ModelError("no key")
    pacer = pacer or Pacer()

    def embed(texts: list[str], query: bool) -> list[list[float]]:
        out: list[list[float]] = []
        wanted = prefixed(texts, query, style_of(model))
        for k in range(0, len(wanted), batch):
            some = wanted[k : k + batch]
            pacer.wait()
            try:
                status, headers, body = post({"input": some, "model": model, "encoding_format": "float"}, key.strip())
            except (OSError, TimeoutError) as e:
                raise ModelError(f"no answer: {e}") from None
            pacer.heard(headers)
            if status == 429:
                pacer.push_back(number(headers.get("retry-after")))
            if status != 200:
                raise ModelError(f"status {status} {HINTS.get(status, '')}".strip())
            data = body.get("data") or []
            if len(data) != len(some):
                raise ModelError("an answer of another length")
            out += [d["embedding"] for d in sorted(data, key=lambda d: d.get("index", 0))]
        return out

    return embed


def patient(embed: Callable, pacer: Pacer, attempts: int = ATTEMPTS) -> Callable:
    """Tries again: first after the time the service names, then after a whole window; then the error stands."""

    def run(texts: list[str], query: bool) -> list[list[float]]:
        for k in range(attempts):
            pacer.check_quota()
            try:
                return embed(texts, query)
            except ModelError:
                if k == attempts - 1:
                    raise
                pacer.sleep(pacer.reset_seconds() if k == 0 else WINDOW)

    return run


def traced_with_fallback(trace: Callable, remote: Callable | None, local: Callable | None) -> tuple[object, bool]:
    """(result, fell back): the whole job again with the local model where the remote one gives up, never a mixture.

    A used-up quota is passed on, so that what is written stays and the job can be resumed.
    """
    try:
        return trace(remote), False
    except QuotaError:
        raise
    except Exception as e:
        caused = isinstance(e, ModelError) or "ModelError" in str(e)
        if "QuotaError" in str(e):
            raise QuotaError(str(e)) from None
        if local is None or not caused:
            raise
        return trace(local), True


@cache
def local_embed(repo: str, batch: int = 16) -> Callable[[list[str], bool], list[list[float]]]:
    """A local sentence model, loaded once in a process and kept in single precision."""
    try:
        from sentence_transformers import SentenceTransformer
    except ImportError as e:
        raise ModelError("sentence_transformers is not installed") from e
    model = SentenceTransformer(repo, device="cpu").float()
    style = style_of(repo)
    return lambda texts, query: model.encode(prefixed(texts, query, style), batch_size=batch, normalize_embeddings=True).tolist()


@cache
def local_inference(repo: str, most_tokens: int = 512) -> Callable[[list[tuple[str, str]]], list[dict]]:
    """A local inference model, loaded once in a process; only premises are cut."""
    try:
        import torch
        from transformers import AutoModelForSequenceClassification, AutoTokenizer
    except ImportError as e:
        raise ModelError("transformers is not installed") from e
    from tracewell.operators.inference import label_order

    tokens, model = AutoTokenizer.from_pretrained(repo), AutoModelForSequenceClassification.from_pretrained(repo).float().eval()

    def logits(pairs):
        with torch.inference_mode():
            return model(**tokens([p for p, _ in pairs], [h for _, h in pairs], return_tensors="pt", padding=True, truncation="only_first", max_length=most_tokens)).logits

    order = label_order(model.config.id2label or {}, lambda p, h: logits([(p, h)])[0].tolist())

    def classify(pairs):
        rows = torch.softmax(logits(pairs), dim=-1).tolist()
        return [dict(zip(("entailment", "neutral", "contradiction"), (r[i] for i in order), strict=True)) for r in rows]

    return classify
