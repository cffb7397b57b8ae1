"""What external scorers ask: a local causal model, or a hosted one.

Both are made on the workers. Their libraries are optional: a local model needs torch and transformers, a
hosted one nothing beyond the standard library.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

CONTEXT = 1024  # tokens a local model sees; what is longer loses its beginning
SYSTEM = "You answer items with several options. Reply with the letter of one option and nothing else."
MAX_REPLY_TOKENS = 16


class ContinuationModel:
    """Log-likelihoods of continuations under a causal model.

    ``encode(text)`` gives token ids; ``logits(ids, mask)`` takes padded ids and the mask of real ones, each of shape
    (rows, length), and gives the next-token logits of every place. An empty continuation is scored as the pad token.
    """

    def __init__(self, encode: Callable[[str], list[int]], logits: Callable[[np.ndarray, np.ndarray], np.ndarray], pad: int, context: int = CONTEXT) -> None:
        self.encode, self.logits, self.pad, self.context = encode, logits, pad, context

    def _ids(self, text: str) -> list[int]:
        return list(self.encode(text)) or [self.pad]

    def lengths(self, continuations: Sequence[str]) -> list[int]:
        return [len(self._ids(c)) for c in continuations]

    def log_likelihoods(self, prompts: Sequence[str], continuations: Sequence[Sequence[str]]) -> list[list[float]]:
        """One batch per prompt: its continuations side by side."""
        return [self._of_one(p, c) for p, c in zip(prompts, continuations)]

    def _of_one(self, prompt: str, options: Sequence[str]) -> list[float]:
        head, tails = self._ids(prompt), [self._ids(o) for o in options]
        rows = [(head + t)[-self.context :] for t in tails]
        width = max(map(len, rows))
        ids, mask = np.full((len(rows), width), self.pad), np.zeros((len(rows), width), dtype=np.int64)
        for i, row in enumerate(rows):
            ids[i, : len(row)], mask[i, : len(row)] = row, 1
        logits = np.asarray(self.logits(ids, mask), dtype=np.float64)
        top = logits.max(axis=-1, keepdims=True)
        log_p = logits - top - np.log(np.exp(logits - top).sum(axis=-1, keepdims=True))
        out = []
        for i, (row, tail) in enumerate(zip(rows, tails)):
            first = max(1, len(row) - len(tail))  # the first token of all has nothing to be predicted from
            at = np.arange(first, len(row))
            out.append(float(log_p[i, at - 1, ids[i, at]].sum()))
        return out


def causal(path: str, dtype: str = "float32", threads: int = 1) -> Callable[[], ContinuationModel]:
    """A loader of a model folder, for ``LocalScorer``; run once per worker."""

    def load() -> ContinuationModel:
        import torch
        from transformers import AutoModelForCausalLM, AutoTokenizer

        torch.set_num_threads(threads)
        tokenizer = AutoTokenizer.from_pretrained(path)
        model = AutoModelForCausalLM.from_pretrained(path, torch_dtype=getattr(torch, dtype)).eval()
        pad = tokenizer.pad_token_id if tokenizer.pad_token_id is not None else tokenizer.eos_token_id

        def logits(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
            with torch.no_grad():
                return model(input_ids=torch.as_tensor(ids), attention_mask=torch.as_tensor(mask)).logits.float().numpy()

        return ContinuationModel(lambda text: tokenizer.encode(text, add_special_tokens=False), logits, pad)

    return load


@dataclass(frozen=True)
class HostedChat:
    """A client of a chat-completions service: called with a prompt, it gives the reply. It pickles; the key goes with it."""

    url: str
    model: str
    key: str | None = None
    system: str = SYSTEM
    max_tokens: int = MAX_REPLY_TOKENS
    timeout: float = 60.0

    def request(self, prompt: str) -> urllib.request.Request:
        messages = [{"role": "system", "content": self.system}, {"role": "user", "content": prompt}]
        body = {"model": self.model, "max_tokens": self.max_tokens, "temperature": 0, "messages": messages}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        return urllib.request.Request(self.url, json.dumps(body).encode(), headers)

    def __call__(self, prompt: str) -> str:
        with urllib.request.urlopen(self.request(prompt), timeout=self.timeout) as answer:
            return json.load(answer)["choices"][0]["message"]["content"] or ""
