"""End-to-end jobs composed of the operators."""

from unitscope.plans.dissection import Dissection, dissect, respond

__all__ = ["Dissection", "dissect", "respond"]
