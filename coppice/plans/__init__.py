"""Composite plans: trees and growers, the boosting loop, prediction, explanation, models."""
