"""Language-model clients: two wire formats, a chain of fallbacks, a cache of answers, and an offline stub."""

from __future__ import annotations

import hashlib
import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

Transport = Callable[[str, dict, dict, float], tuple[int, dict]]


@dataclass
class Config:
    """Settings: the environment first, then a .env file, then defaults."""

    provider: str = "openai"
    base_url: str = ""
    api_key: str = ""
    model: str = ""
    fallbacks: tuple[str, ...] = ()
    timeout: float = 120.0
    workers: int = 6

    @staticmethod
    def load(env_file: str = ".env") -> Config:
        held: dict[str, str] = {}
        if os.path.exists(env_file):
            with open(env_file, encoding="utf-8") as f:
                for line in f:
                    key, sep, value = line.strip().partition("=")
                    if sep and not key.startswith("#"):
                        held[key.strip()] = value.strip().strip("\"'")
        get = lambda name, default: os.environ.get(f"CODESTRATA_{name}", held.get(f"CODESTRATA_{name}", default))
        return Config(get("PROVIDER", "openai"), get("BASE_URL", ""), get("API_KEY", ""), get("MODEL", ""), tuple(filter(None, get("FALLBACKS", "").split(","))), float(get("TIMEOUT", "120")), int(get("WORKERS", "6")))


def http_post(url: str, headers: dict, body: dict, timeout: float) -> tuple[int, dict]:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return reply.status, json.loads(reply.read() or b"{}")
    except urllib.error.HTTPError as e:
        return e.code, {}


@dataclass
class ToolCall:
    id: str
    name: str
    args: dict


@dataclass
class Reply:
    text: str
    calls: list[ToolCall] = field(default_factory=list)
    message: dict = field(default_factory=dict)


def parse_args(raw) -> dict:
    """Tool arguments as a dict: a dict, a JSON object in a string, or nothing."""
    if isinstance(raw, dict):
        return raw
    try:
        out = json.loads(raw or "{}")
    except (TypeError, ValueError):
        return {}
    return out if isinstance(out, dict) else {}


def prompt_hash(model: str, system: str, prompt: str) -> str:
    return hashlib.sha256("\0".join((model, system, prompt)).encode()).hexdigest()


class Offline:
    """Answers nothing; what needs a model is left out."""

    model = "offline"

    def generate(self, prompt: str, system: str = "") -> str | None:
        return None

    def generate_with_tools(self, messages: list[dict], tools: list[dict], system: str = "") -> Reply:
        return Reply("No model is configured.")


class Client:
    """Calls a service; a 429 moves on to the next model of the chain. `generate` gives None where none answers."""

    def __init__(self, config: Config, transport: Transport = http_post, cache: dict | None = None):
        self.config, self.post, self.cache, self.model = config, transport, cache if cache is not None else {}, config.model

    def _request(self, model: str, messages: list[dict], system: str, tools: list[dict]) -> tuple[str, dict, dict]:
        c = self.config
        if c.provider == "anthropic":
            body = {"model": model, "max_tokens": 4096, "messages": messages, **({"system": system} if system else {})}
            if tools:
                body["tools"] = [{"name": t["name"], "description": t["description"], "input_schema": t["parameters"]} for t in tools]
            return f"{c.base_url or 'https://api.anthropic.com'}/v1/messages", {"x-api-key": c.api_key, "anthropic-version": "2023-06-01"}, body
        body = {"model": model, "messages": ([{"role": "system", "content": system}] if system else []) + messages}
        if tools:
            body["tools"] = [{"type": "function", "function": t} for t in tools]
        return f"{c.base_url or 'https://api.openai.com'}/v1/chat/completions", {"Authorization": f"Bearer {c.api_key}"}, body

    def _read(self, reply: dict) -> Reply | None:
        if self.config.provider == "anthropic":
            blocks = reply.get("content") or []
            text = "".join(b.get("text", "") for b in blocks if b.get("type") == "text")
            calls = [ToolCall(b.get("id", ""), b["name"], parse_args(b.get("input"))) for b in blocks if b.get("type") == "tool_use"]
            return Reply(text, calls, {"role": "assistant", "content": blocks}) if blocks else None
        choices = reply.get("choices") or []
        if not choices:
            return None
        message = choices[0].get("message") or {}
        calls = [ToolCall(x.get("id", ""), x["function"]["name"], parse_args(x["function"].get("arguments"))) for x in message.get("tool_calls") or []]
        return Reply(message.get("content") or "", calls, message)

    def _chain(self, messages: list[dict], system: str, tools: list[dict]) -> tuple[str | None, Reply | None, str]:
        """The first answer along the chain; only a model that is busy (429) is passed over, as a wrong key or request would fail with all."""
        error = "no model answered"
        for model in (self.config.model, *self.config.fallbacks):
            try:
                status, raw = self.post(*self._request(model, messages, system, tools), self.config.timeout)
            except (OSError, ValueError) as e:
                return None, None, f"{model}: {e}"
            reply = self._read(raw) if status == 200 else None
            if reply is not None:
                return model, reply, ""
            error = f"{model}: status {status}"
            if status != 429:
                break
        return None, None, error

    def answer(self, prompt: str, system: str = "") -> tuple[str | None, str | None]:
        """An answer, from the cache if there, and the model that gave it; only the first model's answers are cached."""
        key = prompt_hash(self.config.model, system, prompt)
        if key in self.cache:
            return self.cache[key], self.config.model
        model, reply, _ = self._chain([{"role": "user", "content": prompt}], system, [])
        text = reply.text if reply and reply.text else None
        if text is not None and model == self.config.model:
            self.cache[key] = text
        return text, model if text is not None else None

    def generate(self, prompt: str, system: str = "") -> str | None:
        """The text of an answer."""
        return self.answer(prompt, system)[0]

    def generate_with_tools(self, messages: list[dict], tools: list[dict], system: str = "") -> Reply:
        return Reply("No model is configured.")


class Client:
    """Calls a service; a 429 moves on to the next model of the chain. `generate` gives None where none answers."""

    def __init__(self, config: Config, transport: Transport = http_post, cache: dict | None = None):
        self.config, self.post, self.cache, self.model = config, transport, cache if cache is not None else {}, config.model

    def _request(self, model: str, messages: list[dict], system: str, tools: list[dict]) -> tuple[str, dict, dict]:
        c = self.config
        if c.provider == "anthropic":
            body = {"model": model, "max_tokens": 4096, "messages": messages, **({"system": system} if system else {})}
            if tools:
                body["tools"] = [{"name": t["name"], "description": t["description"], "input_schema": t["parameters"]} for t in tools]
            return f"{c.base_url or 'https://api.anthropic.com'}/v1/messages", {"x-api-key": c.api_key, "anthropic-version": "2023-06-01"}, body
        body = {"model": model, "messages": ([{"role": "system", "content": system}] if system else []) + messages}
        if tools:
            body["tools"] = [{"type": "function", "function": t} for t in tools]
        return f"{c.base_url or 'https://api.openai.com'}/v1/chat/completions", {"Authorization": f"Bearer {c.api_key}"}, body

    def _read(self, reply: dict) -> Reply | None:
        if self.config.provider == "anthropic":
            blocks = reply.get("content") or []
            text = "".join(b.get("text", "") for b in blocks if b.get("type") == "text")
            calls = [ToolCall(b.get("id", ""), b["name"], parse_args(b.get("input"))) for b in blocks if b.get("type") == "tool_use"]
            return Reply(text, calls, {"role": "assistant", "content": blocks}) if blocks else None
        choices = reply.get("choices") or []
        if not choices:
            return None
        message = choices[0].get("message") or {}
        calls = [ToolCall(x.get("id", ""), x["function"]["name"], parse_args(x["function"].get("arguments"))) for x in message.get("tool_calls") or []]
        return Reply(message.get("content") or "", calls, message)

    def _chain(self, messages: list[dict], system: str, tools: list[dict]) -> tuple[str | None, Reply | None, str]:
        error = "no model answered"
        for model in (self.config.model, *self.config.fallbacks):
            try:
                status, raw = self.post(*self._request(model, messages, system, tools), self.config.timeout)
            except (OSError, ValueError) as e:
                error = f"{model}: {e}"
                continue
            reply = self._read(raw) if status == 200 else None
            if reply is not None:
                return model, reply, ""
            error = f"{model}: status {status}"
        return None, None, error

    def generate(self, prompt: str, system: str = "") -> str | None:
        """The text of an answer, from the cache if there; only the first model's answers are cached."""
        key = prompt_hash(self.config.model, system, prompt)
        if key in self.cache:
            return self.cache[key]
        model, reply, _ = self._chain([{"role": "user", "content": prompt}], system, [])
        text = reply.text if reply and reply.text else None
        if text is not None and model == self.config.model:
            self.cache[key] = text
        return text

    def generate_with_tools(self, messages: list[dict], tools: list[dict], system: str = "") -> Reply:
        """One turn with tools, not cached; a failure is a text, never empty."""
        _, reply, error = self._chain(messages, system, tools)
        return reply or Reply(f"The model could not be reached: {error}")

    def tool_result(self, call: ToolCall, text: str) -> dict:
        if self.config.provider == "anthropic":
            return {"role": "user", "content": [{"type": "tool_result", "tool_use_id": call.id, "content": text}]}
        return {"role": "tool", "tool_call_id": call.id, "content": text}


def default_client(env_file: str = ".env") -> Client | Offline:
    config = Config.load(env_file)
    return Client(config) if config.api_key and config.model else Offline()
