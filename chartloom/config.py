"""Environment look-ups and logging."""

from __future__ import annotations

import logging
import os

# The variable that holds each platform's key.
KEY_VARIABLES = {"openai": "OPENAI_API_KEY", "anthropic": "ANTHROPIC_API_KEY", "groq": "GROQ_API_KEY", "huggingface": "HUGGINGFACE_API_KEY", "cohere": "COHERE_API_KEY"}


def get_env_var(name: str, default: str | None = None, required: bool = False) -> str | None:
    """A variable's value; an error if it is required and neither set nor given a default."""
    value = os.environ.get(name, default)
    if required and value is None:
        raise ValueError(f"the environment variable {name} is not set")
    return value


def get_api_key_for_platform(platform: str) -> str | None:
    """The key of a platform, whatever the case of its name."""
    if platform.lower() not in KEY_VARIABLES:
        raise ValueError(f"unknown platform: {platform}")
    return get_env_var(KEY_VARIABLES[platform.lower()])


def get_logger(name: str) -> logging.Logger:
    return logging.getLogger(name)


def configure_logging(log_level: str = "INFO", log_file: str | None = None, console: bool = True) -> logging.Logger:
    """The root logger at a level, writing to the console and to a file, anew each time."""
    root = logging.getLogger()
    root.setLevel(getattr(logging, log_level.upper(), logging.INFO))
    root.handlers.clear()
    handlers: list[logging.Handler] = [logging.StreamHandler()] if console else []
    if log_file:
        os.makedirs(os.path.dirname(os.path.abspath(log_file)), exist_ok=True)
        handlers.append(logging.FileHandler(log_file))
    for handler in handlers:
        handler.setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
        root.addHandler(handler)
    return root
