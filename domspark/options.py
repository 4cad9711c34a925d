"""Parse configuration. Instances are plain values and travel to the executors with the parser."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Elements without content.
VOID_TAGS = frozenset("area base basefont br col command embed frame hr img input isindex keygen link menuitem meta param source track wbr".split())


@dataclass(frozen=True)
class Options:
    """error_handling: strict, lenient or ignore. comment_mode: preserve, remove or process_only. whitespace_mode: preserve, normalize,
    trim or remove (which drops every text node). text_processing_mode: raw or decode. br_handling: keep, insert_newline or insert_custom."""

    error_handling: str = "lenient"
    comment_mode: str = "preserve"
    whitespace_mode: str = "preserve"
    text_processing_mode: str = "raw"
    br_handling: str = "keep"
    br_text: str = "\n"
    preserve_case: bool = False
    decode_entities: bool = False
    max_tokens: int = 1_000_000
    max_depth: int = 1_000
    max_attributes: int = 100
    max_attribute_name_length: int = 256
    max_attribute_value_length: int = 8_192
    max_text_length: int = 1_048_576
    max_css3_cache_size: int = 1_000
    void_elements: frozenset[str] = field(default_factory=frozenset)

    @classmethod
    def strict(cls) -> Options:
        return cls(error_handling="strict", max_tokens=100_000, max_depth=100, max_attributes=50)

    @classmethod
    def performance(cls) -> Options:
        return cls(comment_mode="remove", whitespace_mode="remove", max_tokens=10_000_000, max_depth=2_000)

    @classmethod
    def sanitized(cls) -> Options:
        return cls(comment_mode="remove", max_tokens=500_000, max_depth=500, max_attributes=50, max_attribute_name_length=128, max_attribute_value_length=4_096, max_text_length=524_288)

    @property
    def decodes(self) -> bool:
        return self.decode_entities or self.text_processing_mode == "decode"

    def is_void(self, tag: str) -> bool:
        return tag in (self.void_elements or VOID_TAGS)

    def is_valid(self) -> bool:
        return min(self.max_tokens, self.max_depth, self.max_attributes, self.max_attribute_name_length, self.max_attribute_value_length, self.max_text_length) > 0

    def with_void_element(self, tag: str) -> Options:
        return replace(self, void_elements=self.void_elements | {tag})

    def without_void_element(self, tag: str) -> Options:
        return replace(self, void_elements=self.void_elements - {tag})

    def with_default_void_elements(self) -> Options:
        return replace(self, void_elements=frozenset())

    def reset_to_defaults(self) -> Options:
        return Options()
