"""The catalogue of models, providers and routes from YAML."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: The catalogue that ships; prices in dollars per million tokens. Fixed values.
SHIPPED = {
    "providers": {
        "openrouter": {"base_url": "https://openrouter.ai/api/v1", "api_key_env": "FPE_OPENROUTER_API_KEY"},
        "siliconflow": {"base_url": "https://api.siliconflow.cn/v1", "api_key_env": "FPE_SILICONFLOW_API_KEY"},
    },
    "models": {
        "gemini-flash": {"provider": "openrouter", "model_id": "google/gemini-3.1-flash-lite-preview", "max_tokens": 16384, "pricing": {"input": 0.25, "output": 1.5}},
        "gpt-5.4-nano": {"provider": "openrouter", "model_id": "openai/gpt-5.4-nano", "max_tokens": 16384, "pricing": {"input": 0.2, "output": 1.25}},
        "qwen3-vl-8b": {"provider": "openrouter", "model_id": "qwen/qwen3-vl-8b-instruct", "max_tokens": 16384, "pricing": {"input": 0.08, "output": 0.5}},
        "paddleocr": {"provider": "siliconflow", "model_id": "PaddlePaddle/PaddleOCR-VL-1.5", "max_tokens": 16384},
    },
    "routes": {"document": "gemini-flash", "table": "gemini-flash", "image": "gemini-flash", "scan": "paddleocr", "slide": "gemini-flash"},
    "defaults": {"primary": "qwen3-vl-8b", "fallback": "gemini-flash", "concurrency": 5, "timeout": 60},
}


def loaded(path: str = "") -> dict:
    """The catalogue of ``path``, else of ``./vlm_routes.yaml``, else the shipped one; a named file that is missing is an error."""
    import yaml

    if path:
        return yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    here = Path("vlm_routes.yaml")
    return yaml.safe_load(here.read_text(encoding="utf-8")) if here.exists() else SHIPPED


def key_of(env: str) -> str:
    """The key in the variable ``env``, else in that of the same name without the prefix FPE_."""
    return os.environ.get(env, "") or os.environ.get(env.removeprefix("FPE_"), "")


def tables(spark: SparkSession, catalogue: dict) -> dict[str, DataFrame]:
    """models, providers and routes as tables, with the defaults of missing fields."""
    models = [(n, m["provider"], m["model_id"], int(m.get("max_tokens", 8192)), float(m.get("temperature", 0.1)), float(m.get("pricing", {}).get("input", 0.0)), float(m.get("pricing", {}).get("output", 0.0))) for n, m in catalogue.get("models", {}).items()]
    providers = [(n, p["base_url"], p["api_key_env"], bool(key_of(p["api_key_env"]))) for n, p in catalogue.get("providers", {}).items()]
    return {
        "models": spark.createDataFrame(models, "name string, provider string, model_id string, max_tokens int, temperature double, input_price double, output_price double"),
        "providers": spark.createDataFrame(providers, "name string, base_url string, api_key_env string, configured boolean"),
        "routes": spark.createDataFrame(list(catalogue.get("routes", {}).items()), "task string, model string"),
    }
