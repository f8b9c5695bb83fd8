"""Clients without a network or a model, by which the plans of the strategies can be run and compared."""

from __future__ import annotations

from pagemill.operators.models_io import Answer, ModelError


def rendered(data: bytes, dpi: int) -> list[bytes]:
    """A 'picture' of each page: the strings its content shows, a line each."""
    from pagemill.sources import pdf

    return ["\n".join(s.text for line in pdf.lines(p.spans) for s in line).encode("utf-8") for p in pdf.opened(data)[0]]


def recognised(image: bytes) -> list[tuple[list[tuple[float, float]], str, float]]:
    """A box for each line of such a picture, and a blank one."""
    lines = [*image.decode("utf-8", "replace").split("\n"), " "]
    return [([(10.0, 30.0 * i), (200.0, 30.0 * i), (200.0, 30.0 * i + 18), (10.0, 30.0 * i + 18)], t, 0.9) for i, t in enumerate(lines)]


def answered(model: str, prompt: str, content: bytes) -> Answer:
    """What a model 'sees': the last part of its content, in capitals. The model 'full' refuses everything."""
    if model == "full":
        raise ModelError("too busy")
    text = content.decode("utf-8", "replace").strip().split("\n")[-1]
    return Answer(f"{model}: {text.upper()}", len(prompt.split()), len(text))
