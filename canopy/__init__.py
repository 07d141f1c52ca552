"""canopy: Spark-first analytics over sequences, trees and their recurring clades."""
