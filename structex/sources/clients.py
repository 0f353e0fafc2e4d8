"""Model access: one seam, several clients.

A client turns requests (call_id, model, mode, body JSON, plus anything else) into replies: the
same rows with raw (the reply as JSON text) and error (what the provider raised, else null).
Errors of a provider are never retried here.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from structex.functions import account
from structex.operators import modes

# Gateways that speak the same protocol, and the mode to begin with.
COMPATIBLE: dict[str, dict[str, str]] = {
    "deepseek": {"base_url": "https://api.deepseek.com", "mode": modes.TOOLS},
    "groq": {"base_url": "https://api.groq.com/openai/v1", "mode": modes.TOOLS},
    "openrouter": {"base_url": "https://openrouter.ai/api/v1", "mode": modes.TOOLS},
    "together": {"base_url": "https://api.together.xyz/v1", "mode": modes.TOOLS},
    "moonshot": {"base_url": "https://api.moonshot.cn/v1", "mode": modes.TOOLS},
}
VENDORS: dict[str, dict[str, str]] = {
    "openai": {"base_url": "https://api.openai.com/v1", "mode": modes.TOOLS, "package": "openai"},
    "anthropic": {"base_url": "https://api.anthropic.com", "mode": modes.ANTHROPIC_TOOLS, "package": "anthropic"},
    "google": {"base_url": "https://generativelanguage.googleapis.com", "mode": modes.GEMINI_JSON, "package": "google-genai"},
}


class ModelClient(Protocol):
    default_mode: str

    def ask(self, requests: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class RuleClient:
    """Deterministic and native: a column expression over the requests gives the raw reply."""

    raw: Callable[[DataFrame], Column]
    default_mode: str = modes.TOOLS

    def ask(self, requests: DataFrame) -> DataFrame:
        return requests.withColumns({"raw": self.raw(requests), "error": F.lit(None).cast("string")})


@dataclass(frozen=True)
class ReplayClient:
    """Recorded replies, joined by call and attempt."""

    replies: DataFrame
    on: tuple[str, ...] = ("call_id", "attempt")
    default_mode: str = modes.TOOLS

    def ask(self, requests: DataFrame) -> DataFrame:
        return requests.join(self.replies, list(self.on), "left")


def _sdk_call(kwargs: dict, send: Callable[[dict], Any]) -> tuple[str | None, str | None]:
    try:
        reply = send(kwargs)
        reply = reply.model_dump() if hasattr(reply, "model_dump") else reply
        return json.dumps(reply, default=str), None
    except Exception as e:  # whatever an SDK raises is the row's error
        return None, f"{type(e).__name__}: {e}"


@dataclass(frozen=True)
class CallClient:
    """Live calls from the executors: make() builds the sender once per task.

    Each request carries its idempotency key, since a lost task is run again.
    """

    make: Callable[[], Callable[[dict], Any]]
    default_mode: str = modes.TOOLS
    defaults: dict[str, Any] = field(default_factory=dict)
    #: Wall-clock time (time.time()) after which no further call starts: one deadline for all.
    deadline: float | None = None

    def sender(self) -> Callable[[dict], tuple[str | None, str | None]]:
        """Built in a task: sends a body and returns (raw, error)."""
        send, defaults = self.make(), self.defaults
        return lambda body: _sdk_call(defaults | body, send)

    def ask(self, requests: DataFrame) -> DataFrame:
        make, names, deadline, defaults = self.make, requests.columns, self.deadline, self.defaults
        schema = T.StructType([*requests.schema.fields, T.StructField("raw", T.StringType()), T.StructField("error", T.StringType())])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            send = make()
            for frame in frames:
                replies = []
                for body in frame["body"]:
                    late = deadline is not None and time.time() >= deadline
                    replies.append((None, "timeout") if late else _sdk_call(defaults | json.loads(body), send))
                out = frame.copy()
                out["raw"], out["error"] = [r[0] for r in replies], [r[1] for r in replies]
                yield out[[*names, "raw", "error"]]

        return requests.mapInPandas(run, schema)


@dataclass(frozen=True)
class HttpSender:
    """make() of a CallClient over plain HTTP."""

    url: str
    headers: tuple[tuple[str, str], ...] = ()
    timeout_s: float = 600.0
    #: What the interface wants in place of the body of a call.
    shape: Callable[[dict], dict] = dict

    def __call__(self) -> Callable[[dict], Any]:
        def send(body: dict) -> Any:
            data = json.dumps(self.shape(body)).encode()
            request = urllib.request.Request(self.url, data, {"Content-Type": "application/json", **dict(self.headers)})
            with urllib.request.urlopen(request, timeout=self.timeout_s) as reply:
                return json.loads(reply.read())

        return send


# -- SDK objects ----------------------------------------------------------------


def with_timeout(client: CallClient, timeout_ms: int | None, signal_at: float | None = None) -> CallClient:
    """The earlier of a timeout from now and a caller's own deadline, for the whole run."""
    account.check_timeout(timeout_ms)
    ends = [t for t in (signal_at, None if timeout_ms is None else time.time() + timeout_ms / 1000) if t is not None]
    return replace(client, deadline=min(ends)) if ends else client


def _has(obj: Any, path: str) -> bool:
    for name in path.split("."):
        obj = getattr(obj, name, None)
        if obj is None:
            return False
    return callable(obj)


def from_openai(make_sdk: Callable[[], Any], stream: bool = False) -> CallClient:
    def make() -> Callable[[dict], Any]:
        create = make_sdk().chat.completions.create

        def send(body: dict) -> Any:
            if not stream:
                return create(**body)
            options = {"include_usage": True} | (body.pop("stream_options", None) or {})
            reply = create(**body, stream=True, stream_options=options)
            if not hasattr(reply, "__iter__"):
                raise TypeError("the client returned no stream")
            return list(reply)

        return send

    return CallClient(make, modes.TOOLS)


def from_anthropic(make_sdk: Callable[[], Any]) -> CallClient:
    def make() -> Callable[[dict], Any]:
        create = make_sdk().messages.create
        return lambda body: create(**body)

    return CallClient(make, modes.ANTHROPIC_TOOLS)


def from_gemini(make_sdk: Callable[[], Any]) -> CallClient:
    def make() -> Callable[[dict], Any]:
        create = make_sdk().models.generate_content
        return lambda body: create(**body)

    return CallClient(make, modes.GEMINI_JSON)


def to_client(client: Any) -> ModelClient:
    """A client as it is, or the adapter for an SDK object: chat, messages, then models."""
    if callable(getattr(client, "ask", None)):
        return client
    for path, adapter in (
        ("chat.completions.create", from_openai),
        ("messages.create", from_anthropic),
        ("models.generate_content", from_gemini),
    ):
        if _has(client, path):
            return adapter(lambda: client)
    raise TypeError("not a model client: it has neither ask, chat.completions, messages nor models")


def route(name: str) -> dict[str, str]:
    """Where "vendor/model" goes; only the vendor decides."""
    vendor = name.split("/")[0].strip()
    table = {**VENDORS, **COMPATIBLE}
    if vendor not in table:
        raise ValueError(f'unknown provider "{vendor}": one of {", ".join(sorted(table))}')
    return {"vendor": vendor, **table[vendor]}


def gemini_rest(body: dict) -> dict:
    """The body as the REST interface takes it: the model is in the address, config is generationConfig."""
    camel = lambda k: "".join(p if i == 0 else p.capitalize() for i, p in enumerate(k.split("_")))
    rest = {k: v for k, v in body.items() if k not in ("model", "config")}
    if config := body.get("config"):
        rest["generationConfig"] = {camel(k): v for k, v in config.items()}
    return rest


def from_provider(name: str, api_key: str | None = None, base_url: str | None = None, mode: str | None = None) -> CallClient:
    """A live client by name. It needs no SDK: requests go to the vendor's HTTP interface."""
    to = route(name)
    model = name.split("/", 1)[1] if "/" in name else ""
    base = base_url or to["base_url"]
    if to["vendor"] == "anthropic":
        url, headers = f"{base}/v1/messages", (("x-api-key", api_key or ""), ("anthropic-version", "2023-06-01"))
    elif to["vendor"] == "google":
        url, headers = f"{base}/v1beta/models/{model}:generateContent", (("x-goog-api-key", api_key or ""),)
        return CallClient(HttpSender(url, headers, shape=gemini_rest), mode or to["mode"])
    else:
        url, headers = f"{base}/chat/completions", (("Authorization", f"Bearer {api_key or ''}"),)
    return CallClient(HttpSender(url, headers), mode or to["mode"])


def route_column(name: Column) -> tuple[Column, Column, Column]:
    """(vendor, base_url, mode) of provider names in a table; null where the vendor is unknown."""
    vendor = F.trim(F.split(name, "/")[0])
    base, mode = (F.create_map(*[F.lit(x) for k, v in {**VENDORS, **COMPATIBLE}.items() for x in (k, v[field])]) for field in ("base_url", "mode"))
    return vendor, base[vendor], mode[vendor]
