"""Readers and writers of manifests, recognition documents, reports and predictors."""
