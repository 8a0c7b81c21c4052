"""Queries of this package by name, and their SQL."""

from __future__ import annotations

from . import audio_features, bag_minhash, conversation_trie, language_model, license_scan, line_dedup, merkle_manifest, mixing, phrase_dedup, preferences, quality_rules, sentencepiece, url_vocabulary


def queries() -> dict:
    return {
        "op1_sentencepiece": sentencepiece.query,
        "op2_license_scan": license_scan.query,
        "op3_mixing": mixing.query,
        "op4_language_model": language_model.query,
        "op5_phrase_dedup": phrase_dedup.query,
        "op6_audio_features": audio_features.query,
        "op7_bag_minhash": bag_minhash.query,
        "op8_url_vocabulary": url_vocabulary.query,
        "op9_preferences": preferences.query,
        "op10_quality_rules": quality_rules.query,
        "op11_line_dedup": line_dedup.query,
        "op12_merkle_manifest": merkle_manifest.query,
        "op13_conversation_trie": conversation_trie.query,
    }


def oracle_sql() -> dict:
    return {
        "op3_mixing": mixing.ORACLE,
        "op8_url_vocabulary": url_vocabulary.ORACLE,
        "op9_preferences": preferences.ORACLE,
        "op10_quality_rules": quality_rules.ORACLE,
        "op11_line_dedup": line_dedup.ORACLE,
        "op12_merkle_manifest": merkle_manifest.ORACLE,
        "op13_conversation_trie": conversation_trie.ORACLE,
    }
