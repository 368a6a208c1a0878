"""The text generator behind a workflow: one function from prompt to text, and its configuration."""

from __future__ import annotations

import hashlib
import json
import os
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any, Protocol

from weftwork.functions import js

DEFAULT_ENDPOINT = "http://localhost:11434"
KEY_VARIABLES = ("OPENAI_API_KEY", "OPENROUTER_API_KEY")
# Signs of a refused key in a failure message.
AUTH_SIGNS = ("http 401", "http 403", "unauthorized", "forbidden", "invalid api key", "authentication")


class ModelError(RuntimeError):
    pass


@dataclass(frozen=True)
class ModelOptions:
    model: str = "stub"
    max_tokens: int = 1000
    temperature: float = 0.7
    think: bool = False
    reasoning_mode: str = "off"

    def merged(self, **more: Any) -> ModelOptions:
        """Options of a call win over those of the session."""
        return replace(self, **{k: v for k, v in more.items() if v is not None})


class ModelClient(Protocol):
    def complete(self, prompt: str, options: ModelOptions, system: str = "") -> str: ...


@dataclass
class StubClient:
    """Deterministic text from the prompt alone; safe to run again when a task is retried."""

    function: Callable[[str], str] | None = None

    def complete(self, prompt: str, options: ModelOptions, system: str = "") -> str:
        return self.function(prompt) if self.function else js.to_json({"digest": hashlib.sha256(prompt.encode()).hexdigest()[:16]})


@dataclass
class ScriptedClient:
    """Replies in order; an exception among them is raised.  For the driver, in tests."""

    replies: list[Any]
    prompts: list[str] = field(default_factory=list)

    def complete(self, prompt: str, options: ModelOptions, system: str = "") -> str:
        self.prompts.append(prompt)
        if not self.replies:
            raise ModelError("the script has no reply left")
        reply = self.replies.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply


def reasoning_fields(options: ModelOptions) -> dict:
    """What a request carries for the reasoning mode."""
    if options.reasoning_mode == "think":
        return {"think": options.think}
    return {"reasoning": {"enabled": options.think}} if options.reasoning_mode == "openai" else {}


def endpoint_of(provider: str, endpoint: str | None = None) -> str:
    """The chat completion address of a base address; both providers speak the same protocol below ``v1``."""
    if provider not in ("openai", "ollama"):
        raise ValueError(f"Unsupported provider: {provider}. Expected one of: openai, ollama.")
    base = js.trim(endpoint or "").rstrip("/") or DEFAULT_ENDPOINT
    if base.endswith("/chat/completions"):
        return base
    return f"{base}/chat/completions" if base.endswith("/v1") else f"{base}/v1/chat/completions"


def api_key_of(given: str | None, variable: str | None, env: Mapping[str, str] | None = None) -> str | None:
    """The key that is given, else that of the workflow's variable (which must be set), else of a usual variable."""
    env = os.environ if env is None else env
    if js.trim(given or ""):
        return js.trim(given)
    if js.trim(variable or ""):
        found = js.trim(env.get(js.trim(variable), ""))
        if not found:
            raise ValueError(f"Pipeline requires API key env '{js.trim(variable)}', but it is not set or is empty.")
        return found
    return next((v for n in KEY_VARIABLES if (v := js.trim(env.get(n, "")))), None)


def complete_once(client: ModelClient, prompt: str, options: ModelOptions | None = None, system: str = "", **more: Any) -> str:
    """One answer without a session."""
    return js.trim(client.complete(prompt, (options or ModelOptions()).merged(**more), system))


@dataclass
class HttpClient:
    """A chat completion service.  Each call stands alone: no history is carried, so calls can run anywhere."""

    endpoint: str
    api_key: str | None = None
    headers: Mapping[str, str] = field(default_factory=dict)
    timeout: float = 120

    def complete(self, prompt: str, options: ModelOptions, system: str = "") -> str:
        messages = [*([{"role": "system", "content": system}] if system else []), {"role": "user", "content": prompt}]
        body = {"model": options.model, "messages": messages, "max_tokens": options.max_tokens, "temperature": options.temperature} | reasoning_fields(options)
        headers = {"Content-Type": "application/json", **({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {}), **self.headers}
        try:
            with urllib.request.urlopen(urllib.request.Request(self.endpoint, json.dumps(body).encode(), headers), timeout=self.timeout) as r:  # noqa: S310
                return js.trim(json.load(r)["choices"][0]["message"]["content"])
        except urllib.error.HTTPError as e:
            raise ModelError(f"HTTP {e.code}: {e.read().decode(errors='replace')}") from e
        except (OSError, KeyError, IndexError, ValueError) as e:
            raise ModelError(str(e)) from e


def is_auth_failure(message: str) -> bool:
    low = message.lower()
    return any(s in low for s in AUTH_SIGNS)


def model_name(cli: str | None, document: dict, env: Mapping[str, str] | None = None) -> str:
    env = os.environ if env is None else env
    found = cli or document.get("model") or env.get("WEFTWORK_MODEL") or env.get("OLLAMA_MODEL")
    if not found:
        raise ValueError("Model is required. Set pipeline.model, pass --model, or set WEFTWORK_MODEL (or OLLAMA_MODEL).")
    return found


def stream_tokens(chunks: Any) -> Any:
    """Text deltas of a server-sent event stream, whatever way it is cut into chunks."""
    held = ""
    for chunk in chunks:
        held += chunk
        *lines, held = held.split("\n")
        for line in lines:
            line = line.strip()
            if not line.startswith("data:") or line[5:].strip() == "[DONE]":
                continue
            delta = json.loads(line[5:])["choices"][0].get("delta", {}).get("content")
            if delta:
                yield delta
