"""Operators for preparing large training corpora.

Each module holds one operator with its own general interface; ``queries``
holds the thin contract queries, ``store`` the shared-folder tables and
``textops`` the vectorised tokenisation that the scan-side code shares.
"""
