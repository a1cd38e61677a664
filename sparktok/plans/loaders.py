"""Tokenizers from tokenizer.json, from rank files, from a folder or a hub cache."""

from __future__ import annotations

import base64
import json
import os
import re
from pathlib import Path

from ..functions import schemes
from .model import AddedToken, Metaspace, TokenizerModel

END_OF_TEXT = "<|endoftext|>"
BYTE_TOKEN = re.compile(r"<0x([0-9A-F]{2})>")
#: Bytes that never occur in UTF-8.
NEVER_IN_UTF8 = frozenset((0xC0, 0xC1, *range(0xF5, 0x100)))


class UnsupportedTokenizer(ValueError):
    """The file is a tokenizer of a kind that this package doesn't have."""


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in byte-level files: itself if printable, else the next from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in printable}
    for b in range(0x100):
        if b not in out.values():
            out[chr(0x100 + len(out) - len(printable))] = b
    return out


_ALPHABET = byte_alphabet()


def _family(model: dict) -> str | None:
    """Name of an unsupported model family, also for old files that don't name theirs."""
    kind = model.get("type")
    if kind is not None:
        return None if kind == "BPE" else kind
    if model.get("unk_id") is not None:
        return "Unigram (untyped legacy file)"
    return "WordPiece (untyped legacy file)" if model.get("max_input_chars_per_word") is not None else None


def load_hf_json(data: bytes | str) -> TokenizerModel:
    """A model from the contents of a tokenizer.json; ``byte_fallback`` decides its kind."""
    try:
        tree = json.loads(data)
        model = tree["model"]
        family = _family(model)
        if family:
            raise UnsupportedTokenizer(f'unsupported model type "{family}": only BPE is supported')
        model["vocab"], model["merges"]  # noqa: B018
    except (ValueError, KeyError, TypeError) as e:
        if isinstance(e, UnsupportedTokenizer):
            raise
        raise ValueError(f"failed to parse tokenizer JSON: {e!r}") from e
    return _piece_model(tree) if model.get("byte_fallback") else _byte_model(tree)


def _merge_pairs(merges: list) -> list[tuple[str, str]]:
    return [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in merges]


def _resolve(pairs, ids: dict) -> tuple[tuple[int, int, int], ...]:
    """Merges by id; those that name unknown tokens are left out, the first of repeated pairs counts."""
    out: dict[tuple[int, int], int] = {}
    for left, right in pairs:
        a, b, c = ids.get(left), ids.get(right), ids.get(left + right)
        if a is not None and b is not None and c is not None:
            out.setdefault((a, b), c)
    return tuple((a, b, c) for (a, b), c in out.items())


def _added(tree: dict) -> list[AddedToken]:
    return [AddedToken(t["content"], t["id"], t.get("lstrip", False), t.get("rstrip", False), t.get("normalized", False), t.get("special", False)) for t in tree.get("added_tokens") or []]


def _by_id(entries: dict[int, bytes], added: list[AddedToken]) -> tuple[bytes, ...]:
    out = [b""] * (1 + max([*entries, *(t.id for t in added)], default=-1))
    for i, b in entries.items():
        out[i] = b
    for t in added:
        if not out[t.id]:
            out[t.id] = t.content.encode()
    return tuple(out)


def _children(node: dict | None, key: str) -> list[dict]:
    """A normalizer or pre-tokenizer as the list of its steps."""
    if not node:
        return []
    return [x for child in node.get(key) or [] for x in _children(child, key)] if node.get("type") == "Sequence" else [node]


def _token_bytes(token: str) -> bytes:
    """Bytes of a byte-level token; characters that stand for no byte are taken as they are."""
    if all(c in _ALPHABET for c in token):
        return bytes(_ALPHABET[c] for c in token)
    return token.encode()


def check_bytes(vocab: tuple[bytes, ...]) -> None:
    """Every byte that UTF-8 can have must be a token."""
    missing = set(range(256)) - {b[0] for b in vocab if len(b) == 1} - NEVER_IN_UTF8
    if missing:
        raise ValueError(f"vocabulary lacks single-byte tokens: {sorted(missing)}")


def _byte_model(tree: dict) -> TokenizerModel:
    model, added = tree["model"], _added(tree)
    contents = {t.content for t in added}
    entries = {i: tok.encode() if tok in contents else _token_bytes(tok) for tok, i in model["vocab"].items()}
    vocab = _by_id(entries, added)
    check_bytes(vocab)
    steps = _children(tree.get("normalizer"), "normalizers")
    if any(s.get("type") != "NFC" for s in steps):
        raise UnsupportedTokenizer(f"unsupported normalizer: {[s.get('type') for s in steps]}")
    scheme, prefix = _pretokenizer(tree.get("pre_tokenizer"))
    return TokenizerModel("byte", vocab, _resolve(_merge_pairs(model["merges"]), model["vocab"]), tuple(added), scheme, bool(steps), prefix, bool(model.get("ignore_merges")))


def _pretokenizer(node: dict | None) -> tuple[str, bool]:
    """Scheme and prefix-space flag of a byte-level pre-tokenizer."""
    patterns, prefix = [], False
    for step in _children(node, "pretokenizers"):
        if step.get("type") == "Split":
            pattern = step.get("pattern") or {}
            if "Regex" not in pattern:
                raise UnsupportedTokenizer(f"unsupported split pattern: {pattern}")
            patterns.append(pattern["Regex"])
        elif step.get("type") == "ByteLevel":
            prefix = prefix or bool(step.get("add_prefix_space"))
        else:
            raise UnsupportedTokenizer(f"unsupported pre-tokenizer: {step.get('type')}")
    try:
        return (schemes.by_patterns(tuple(patterns)) if patterns else schemes.DEFAULT), prefix
    except ValueError as e:
        raise UnsupportedTokenizer(str(e)) from e


def _piece_step(step: dict) -> tuple[str, tuple]:
    kind, pattern = step.get("type"), step.get("pattern") or {}
    if kind == "Prepend" and step.get("prepend") is not None:
        return "prepend", (step["prepend"],)
    if kind == "Replace" and step.get("content") is not None and "String" in pattern:
        return "replace", (pattern["String"], step["content"])
    if kind == "Replace" and step.get("content") is not None and pattern.get("Regex") == " {2,}":
        return "collapse", (step["content"],)
    if kind == "Strip":
        return "strip", (step.get("strip_left", True), step.get("strip_right", True))
    if kind == "Precompiled" and step.get("precompiled_charsmap") is not None:
        return "charsmap", (base64.b64decode(step["precompiled_charsmap"]),)
    raise UnsupportedTokenizer(f"unsupported normalizer: {step}")


def _piece_model(tree: dict) -> TokenizerModel:
    model, added = tree["model"], _added(tree)
    ids = model["vocab"]
    if not any(BYTE_TOKEN.fullmatch(t) for t in ids):
        raise ValueError("byte_fallback is set but the vocabulary has no <0xHH> tokens")
    entries = {i: bytes([int(m[1], 16)]) if (m := BYTE_TOKEN.fullmatch(t)) else t.encode() for t, i in ids.items()}
    steps = tuple(_piece_step(s) for s in _children(tree.get("normalizer"), "normalizers"))
    meta = None
    for step in _children(tree.get("pre_tokenizer"), "pretokenizers"):
        if step.get("type") == "Metaspace":
            old = "always" if step.get("add_prefix_space", True) else "never"
            meta = Metaspace(step.get("replacement", "▁"), step.get("prepend_scheme", old), step.get("split", True))
            if meta.prepend not in ("always", "first", "never"):
                raise UnsupportedTokenizer(f"unsupported prepend_scheme: {meta.prepend}")
        elif not (step.get("type") == "Split" and (step.get("pattern") or {}).get("String") == " " and step.get("behavior") == "MergedWithPrevious"):
            raise UnsupportedTokenizer(f"unsupported pre-tokenizer: {step.get('type')}")
    return TokenizerModel("piece", _by_id(entries, added), _resolve(_merge_pairs(model["merges"]), ids), tuple(added), steps=steps, metaspace=meta, extra={"pieces": dict(ids)})


def _ranks(data: bytes) -> list[bytes]:
    out: dict[int, bytes] = {}
    for number, line in enumerate(data.splitlines(), 1):
        if not line.strip():
            continue
        fields = line.split()
        if len(fields) != 2:
            raise ValueError(f"line {number}: expected a base64 token and a rank")
        out[int(fields[1])] = base64.b64decode(fields[0])
    if sorted(out) != list(range(len(out))):
        raise ValueError("ranks are not dense from 0")
    return [out[i] for i in range(len(out))]


def _merges_of_ranks(tokens: list[bytes]) -> tuple[tuple[int, int, int], ...]:
    """The pair that each token of several bytes is merged from: what is left of it under the ranks before its own."""
    rank = {t: i for i, t in enumerate(tokens)}
    out = []
    for i, token in enumerate(tokens):
        if len(token) < 2:
            continue
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda k: rank.get(parts[k] + parts[k + 1], i))
            if rank.get(parts[best] + parts[best + 1], i) >= i:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) != 2 or parts[0] not in rank or parts[1] not in rank:
            raise ValueError(f"token {i} is not a merge of two earlier ones")
        out.append((rank[parts[0]], rank[parts[1]], i))
    return tuple(out)


def from_tiktoken(data: bytes, scheme: str = schemes.DEFAULT) -> TokenizerModel:
    """A byte-level model from lines of base64 token and rank; the end-of-text token follows the last rank."""
    tokens = _ranks(data)
    end = AddedToken(END_OF_TEXT, len(tokens), special=True)
    vocab = (*tokens, END_OF_TEXT.encode())
    check_bytes(vocab)
    return TokenizerModel("byte", vocab, _merges_of_ranks(tokens), (end,), schemes.by_name(scheme))


def from_tiktoken_model(data: bytes, config: dict, scheme: str) -> TokenizerModel:
    """Ranks, the special tokens of a tokenizer_config.json, and a scheme by name."""
    tokens, added = _ranks(data), []
    for key, spec in (config.get("added_tokens_decoder") or {}).items():
        if int(key) < len(tokens):
            raise ValueError(f"special token {spec['content']!r} has the id of a rank: {key}")
        added.append(AddedToken(spec["content"], int(key), spec.get("lstrip", False), spec.get("rstrip", False), spec.get("normalized", False), spec.get("special", True)))
    vocab = _by_id(dict(enumerate(tokens)), added)
    check_bytes(vocab)
    return TokenizerModel("byte", vocab, _merges_of_ranks(tokens), tuple(added), schemes.by_name(scheme))


def looks_like_repo_id(name: str) -> bool:
    """One or two parts of letters, digits, ``-``, ``_`` and ``.`` that is no path."""
    return bool(re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*(?:/[A-Za-z0-9][A-Za-z0-9._-]*)?", name)) and ".." not in name and not name.endswith((".json", ".tiktoken"))


def hub_cache(env: dict | None = None) -> Path:
    env = os.environ if env is None else env
    home = env.get("HF_HOME") or os.path.join(env.get("XDG_CACHE_HOME") or os.path.expanduser("~/.cache"), "huggingface")
    return Path(env.get("HF_HUB_CACHE") or os.path.join(home, "hub"))


def hub_token(env: dict | None = None) -> str | None:
    """Access token from the environment or the token file."""
    env = os.environ if env is None else env
    if env.get("HF_TOKEN"):
        return env["HF_TOKEN"].strip()
    path = Path(env.get("HF_TOKEN_PATH") or hub_cache(env).parent / "token")
    return (path.read_text().strip() or None) if path.is_file() else None


def hub_file(repo_id: str, filename: str, repo_type: str = "model", revision: str = "main", env: dict | None = None) -> Path:
    """A file of a hub repository: from the cache if it is there, else downloaded into it."""
    env = os.environ if env is None else env
    folder = hub_cache(env) / f"{repo_type}s--{repo_id.replace('/', '--')}"
    ref = folder / "refs" / revision
    commit = ref.read_text().strip() if ref.is_file() else revision
    there = folder / "snapshots" / commit / filename
    if there.is_file():
        return there
    if env.get("HF_HUB_OFFLINE") in ("1", "true", "TRUE"):
        raise FileNotFoundError(f"{repo_id}/{filename} is not in the cache and HF_HUB_OFFLINE is set")
    import urllib.request

    prefix = "" if repo_type == "model" else f"{repo_type}s/"
    url = f"{env.get('HF_ENDPOINT', 'https://huggingface.co').rstrip('/')}/{prefix}{repo_id}/resolve/{revision}/{filename}"
    request = urllib.request.Request(url)
    if token := hub_token(env):
        request.add_unredirected_header("Authorization", f"Bearer {token}")
    there.parent.mkdir(parents=True, exist_ok=True)
    part = there.with_name(f".{there.name}.{os.getpid()}.part")
    try:
        with urllib.request.urlopen(request) as got, part.open("wb") as out:
            while block := got.read(1 << 20):
                out.write(block)
        part.replace(there)
    finally:
        part.unlink(missing_ok=True)
    return there


def load(name: str | os.PathLike) -> TokenizerModel:
    """A ``.tiktoken`` file, a tokenizer.json or its folder, or a hub repository."""
    path = Path(name)
    if path.suffix == ".tiktoken" and path.is_file():
        return from_tiktoken(path.read_bytes())
    if path.is_dir():
        path = path / "tokenizer.json"
    if path.is_file():
        return load_hf_json(path.read_bytes())
    if looks_like_repo_id(str(name)):
        return load_hf_json(hub_file(str(name), "tokenizer.json").read_bytes())
    raise FileNotFoundError(f"no tokenizer file, folder or repository: {name}")
